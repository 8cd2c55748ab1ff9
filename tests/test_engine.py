"""Rules of the engine that no query shows: types of columns, views, stored data, bounds of answers."""

import pytest
from pyspark.sql import functions as F

from strandmill.catalog import ROW, Catalog, QueryError
from strandmill.client import with_flags
from strandmill.file_queries import Desk
from strandmill.plans.column_query import column_query, columnar
from strandmill.plans.expression import run
from strandmill.plans.relational import relational_query
from strandmill.streaming.counts import FolderCounts


def segments(rows, extra="7"):
    return "sample\tchr\tstart\tend\tvalue\tscore\n" + "".join(f"s{i}\t1\t{i + 1}\t{i + 2}\t{'0.5' if i != 28 else rows}\t{'3' if i < 25 else extra}\n" for i in range(30))


def test_columns_are_typed_over_all_rows(spark):
    """A text or a bad number far down the file is seen: the column is a category, or the load fails."""
    c = Desk(spark).text("seg", segments("1e2", "late text"), type="genomicSegment").load("seg")
    ds = c.dataset("seg")
    assert (ds.fields["score"].type, ds.fields["value"].type) == ("category", "float")
    assert columnar(column_query(c, {"select": ["score"], "from": ["seg"], "limit": 1, "offset": 26}))["score"] == ["late text"]
    bad = Desk(spark).text("seg", segments("oops"), type="genomicSegment")
    ds = bad.loader.load("seg")
    assert ds.meta["status"] == "error" and "no numbers" in ds.meta["metadata"]["error"]
    missing = Desk(spark).text("seg", segments("NA", "NA"), type="genomicSegment").load("seg").dataset("seg")
    assert missing.fields["score"].type == "float" and missing.df.where("value is null").count() == 1


def test_replaced_data_stay_until_vacuum(spark):
    desk = Desk(spark).text("clin", "id\tx\na\t1\n", type="clinicalMatrix")
    old = desk.load("clin").dataset("clin").df
    desk.text("clin", "id\tx\na\t1\nb\t2\n").load("clin")
    assert old.count() == 1 and desk.catalog.dataset("clin").df.count() == 2
    assert len(desk.loader.vacuum()) == 1 and desk.loader.vacuum() == [] and desk.catalog.dataset("clin").df.count() == 2
    desk.loader.delete("clin")
    assert len(desk.loader.vacuum()) == 1


def test_relational_queries_make_what_they_name_and_leave_nothing(spark):
    c = Catalog(spark)
    c.use_tables(a=spark.createDataFrame([(1, "x", 5), (1, "x", 6), (2, "y", None)], "id int, name string, v int"), b=spark.createDataFrame([(1,)], "id int"))
    made = []
    system = c.system
    c.system = lambda name: made.append(name) or system(name)
    views = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("mill_")}
    before = views()
    q = {":select": [":name", [":%sum.v", ":total"]], ":from": [":a"], ":group-by": [":id"]}
    df = relational_query(c, q)
    assert made == ["a"] and views() == before
    assert sorted(map(tuple, df.collect()), key=repr) == [("x", 11), ("y", None)]
    for join, want in (("semi-join", [1, 1]), ("anti-join", [2])):
        q = {":select": [":a.id"], ":from": [":a"], f":{join}": [":b", [":=", ":a.id", ":b.id"]]}
        assert sorted(r[0] for r in relational_query(c, q).collect()) == want
    with pytest.raises(QueryError):
        relational_query(c, {":select": [":x"], ":from": [":nowhere"]})
    assert views() == before


def test_answers_have_a_bound(spark):
    c = Catalog(spark)
    c.register("n", spark.range(50).select(F.col("id").alias(ROW), (F.col("id") * 2).cast("double").alias("v")))
    q = {"select": ["v"], "from": ["n"]}
    assert columnar(column_query(c, q), 50)["v"][:3] == [0.0, 2.0, 4.0]
    with pytest.raises(QueryError, match="more than 49"):
        columnar(column_query(c, q), 49)
    free = column_query(c, {**q, "where": ["in", "v", [4, 8]]}, ordered=False)
    assert "Sort" not in free._jdf.queryExecution().executedPlan().toString() and sorted(r["v"] for r in free.collect()) == [4.0, 8.0]


def test_only_the_column_that_is_mapped_is_planned(spark, monkeypatch):
    from strandmill.plans import expression

    c = Catalog(spark)
    c.use_tables(t=spark.createDataFrame([(2, "b"), (1, "a")], "k int, s string"))
    seen = []
    collected = expression.collected
    monkeypatch.setattr(expression, "collected", lambda df, most=None: seen.append(df.columns) or collected(df, most))
    query = "(query {:select [:k :s] :from [:t] :order-by [:k]})"
    assert run(f"(map :s {query})", catalog=c) == ["a", "b"] and seen == [["s"]]
    assert run(f"(map :none {query})", catalog=c) == [None, None] and run(f"(count {query})", catalog=c) == 2
    assert run(f"(map (fn [r] (get r :k)) {query})", catalog=c) == [1, 2] and seen[-1] == ["k", "s"]


def test_flags_of_fields(spark):
    field = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    got = with_flags(field, genes=spark.createDataFrame([(2, "g"), (2, "h"), (None, "x")], "field_id int, gene string"), codes=spark.createDataFrame([], "field_id int"))
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, False, False), (2, True, False), (None, False, False)]


def test_folder_counts_go_on_where_they_stopped(spark, tmp_path):
    at = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "k string, n long").coalesce(1).write.mode("append").parquet(at)
    put([("a", 1), ("b", 5), (None, 2)])
    counts = FolderCounts(spark, at, spark.read.parquet(at).schema, str(tmp_path / "state"), ["k"], "n")
    got = lambda: sorted(map(tuple, counts.read().collect()), key=repr)
    counts.update()
    assert got() == [("a", 1, 1), ("b", 1, 5), (None, 1, 2)]
    put([("a", 9)])
    counts.update()
    counts.update()
    assert got() == [("a", 2, 9), ("b", 1, 5), (None, 1, 2)]
    counts._partial(spark.createDataFrame([("a", 9)], "k string, n long"), 1)  # a batch that is run again
    assert got() == [("a", 2, 9), ("b", 1, 5), (None, 1, 2)]
