import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandmill.catalog import ROW, Catalog, QueryError, UnknownDataset, with_rows
from strandmill.operators.overlap import overlap_join
from strandmill.plans.column_query import column_query, columnar
from strandmill.plans.fetch import fetch
from strandmill.sources.loader import write_dataset

NAN = float("nan")


@pytest.fixture(scope="module")
def cat(spark):
    c = Catalog(spark)
    pos = "struct<chrom string, chromStart int, chromEnd int, strand string>"
    rows = [
        (0, "s1", 1.5, ["GeneA"], ("chr1", 10, 20, "+")),
        (1, "s2", 2.5, ["GeneB", "GeneC"], ("chr1", 21, 30, "+")),
        (2, "s1", NAN, None, ("chr2", 10, 20, "-")),
        (3, None, None, [], None),
        (4, "s3", 4.0, ["genea", "GeneC"], ("chr1", 5, 40, ".")),
    ]
    df = spark.createDataFrame(rows, f"{ROW} long, sampleID string, v float, genes array<string>, position {pos}")
    write_dataset(c, "d", df)
    return c


def ask(cat, where=None, select=("v",), **kw):
    df = column_query(cat, {"select": list(select), "from": ["d"], "where": where, **kw})
    return [r[ROW] for r in df.collect()]


def test_membership(cat):
    assert ask(cat, ["in", "sampleID", ["s1", None]]) == [0, 2]
    assert ask(cat, ["in", "v", [1.5, 4]]) == [0, 4]
    assert ask(cat, ["in", "v", [NAN, None, "x"]]) == []
    assert ask(cat, ["in", "sampleID", []]) == []


def test_long_lists(cat, monkeypatch):
    from strandmill.plans import column_query as C

    monkeypatch.setattr(C, "LONG_LIST", 1)
    assert ask(cat, ["in", "sampleID", ["s1", None, "s1"]]) == [0, 2]
    assert ask(cat, ["and", ["in", "v", [1.5, 4, NAN, None, "x"]], ["in", "sampleID", ["s1", "s2", "s9"]]]) == [0]
    assert ask(cat, ["or", ["in", "v", [1.5, 4]], ["in", "sampleID", ["s2", "s9"]]]) == [0, 1, 4]
    assert ask(cat, ["and", ["in", "genes", ["genea", "geneb"]], ["in", "v", [2.5, 4]]], limit=1, offset=1) == [4]


def test_gene_lists(cat):
    assert ask(cat, ["in", "any", "genes", ["GENEA"]]) == [0, 4]
    assert ask(cat, ["in", "genes", ["genec", None]]) == [1, 4]
    assert ask(cat, ["in", "all", "genes", ["GeneA", "GeneB", "GeneC"]]) == [0, 1, 2, 3, 4]
    assert ask(cat, ["in", "all", "genes", ["GeneA"]]) == [0, 2, 3]
    assert ask(cat, ["in", "any", "genes", []]) == []


def test_positions(cat):
    assert ask(cat, ["in", "position", [["chr1", 20, 21]]]) == [0, 1, 4]
    assert ask(cat, ["in", "position", [["chr1", 41, 50], ["chr2", 1, 10]]]) == [2]
    assert ask(cat, ["and", ["in", "position", [["chr1", 1, 100]]], ["in", "position", [["chr1", 30, 30]]]]) == [1, 4]


def test_logic_and_windows(cat):
    assert ask(cat, ["or", ["in", "v", [1.5]], ["and", ["in", "sampleID", ["s3"]], ["in", "any", "genes", ["genec"]]]]) == [0, 4]
    assert ask(cat, ["and"]) == [0, 1, 2, 3, 4] and ask(cat, ["or"]) == [] and ask(cat) == [0, 1, 2, 3, 4]
    assert ask(cat, ["in", "v", [1.5, 2.5, 4]], limit=1, offset=1) == [1]
    assert ask(cat, limit=2) == [0, 1] and ask(cat, offset=4) == [4] and ask(cat, limit=0) == []


def test_shape_of_results(cat):
    got = columnar(column_query(cat, {"select": ["v", "nope", "v", "position"], "from": ["d"], "limit": 1}))
    assert list(got) == ["v", "nope", "position"] and got["nope"] == [None]
    assert got["position"] == [{"chrom": "chr1", "chromstart": 10, "chromend": 20, "strand": "+"}]
    assert ask(cat, ["in", "nope", ["x"]]) == []


def test_errors(cat):
    with pytest.raises(UnknownDataset):
        column_query(cat, {"select": ["v"], "from": ["none"]})
    for bad in (["like", "v", ["x"]], ["in", "some", "v", ["x"]], ["in", "v"]):
        with pytest.raises(QueryError):
            column_query(cat, {"select": ["v"], "from": ["d"], "where": bad})
    with pytest.raises(QueryError):
        column_query(cat, {"select": ["v"]})


def test_fetch_order_repeats_and_misses(cat):
    got = fetch(cat, [{"table": "d", "columns": ["v", "nope", "sampleID"], "samples": ["s3", "s1", "nobody", "s3"]}])
    same = lambda a, b: all((x != x and y != y) or x == y for x, y in zip(a, b)) and len(a) == len(b)
    assert same(got[0], [4.0, 1.5, NAN, NAN, 4.0])
    assert same(got[1], [NAN] * 5)
    assert same(got[2], [2.0, 0.0, 0.0, NAN, 2.0])
    assert fetch(cat, [{"table": "d", "columns": [], "samples": ["s1"]}]) == []
    assert fetch(cat, {"table": "d", "columns": ["v"], "samples": []}) == [[]]


def tree():
    leaf = st.one_of(
        st.tuples(st.just("in"), st.just("sampleID"), st.lists(st.sampled_from(["s1", "s2", "s3", "zz"]), max_size=3)),
        st.tuples(st.just("in"), st.just("any"), st.just("genes"), st.lists(st.sampled_from(["genea", "GENEB", "x"]), max_size=2)),
        st.tuples(st.just("in"), st.just("all"), st.just("genes"), st.lists(st.sampled_from(["genea", "geneb", "genec"]), max_size=3)),
        st.tuples(st.just("in"), st.just("v"), st.lists(st.sampled_from([1.5, 2.5, 9]), max_size=2)),
    )
    return st.recursive(leaf, lambda k: st.tuples(st.sampled_from(["and", "or"]), k, k), max_leaves=5)


ROWS = [("s1", 1.5, ["genea"]), ("s2", 2.5, ["geneb", "genec"]), ("s1", None, []), (None, None, []), ("s3", 4.0, ["genea", "genec"])]


def holds(p, row):
    if p[0] == "and":
        return all(holds(x, row) for x in p[1:])
    if p[0] == "or":
        return any(holds(x, row) for x in p[1:])
    vals = {v.lower() if isinstance(v, str) and len(p) == 4 else v for v in p[-1]}
    if len(p) == 4:
        return (any if p[1] == "any" else all)(g in vals for g in row[2])
    x = row[0] if p[1] == "sampleID" else row[1]
    return x is not None and x in vals


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(tree())
def test_against_plain_python(cat, p):
    assert ask(cat, p) == [i for i, r in enumerate(ROWS) if holds(p, r)]


def test_rows_are_numbered_in_order(spark):
    df = with_rows(spark.range(0, 1000).selectExpr("(id * 7919) % 1000 as k"), "k")
    assert df.where(f"k <> {ROW}").count() == 0 and df.count() == 1000


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_overlap_join(spark, data):
    edge = st.builds(lambda m, d: max(0, m * 131072 + d), st.integers(0, 40), st.integers(-5, 5))
    iv = st.lists(st.tuples(st.sampled_from(["a", "b", None]), edge, st.integers(-1, 300000)), max_size=12)
    a, b = data.draw(iv), data.draw(iv)
    A = [(i, c, s, s + n) for i, (c, s, n) in enumerate(a)]
    B = [(i, c, s, s + n) for i, (c, s, n) in enumerate(b)]
    left, right = spark.createDataFrame(A, "i int, c string, s long, e long"), spark.createDataFrame(B, "j int, c2 string, s2 long, e2 long")
    want = sorted((i, j) for i, c, s, e in A for j, d, x, y in B if c is not None and c == d and e >= s and y >= x and s <= y and e >= x)
    got = overlap_join(left, right, ("c", "c2"), ("s", "e"), ("s2", "e2"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    semi = overlap_join(left, right, ("c", "c2"), ("s", "e"), ("s2", "e2"), how="left_semi")
    assert sorted(r["i"] for r in semi.collect()) == sorted({i for i, _ in want})
