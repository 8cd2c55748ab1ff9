import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandmill.operators.cover import cover

SCHEMA = "field_id int, chrom string, s int, e int"


def brute(data):
    """Periods and gaps by merging sorted intervals."""
    by = {}
    for f, c, s, e in data:
        if s is not None and e is not None and e >= s:
            by.setdefault((f, c), set()).add((s, e))
    out = set()
    for k, iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(*k, "period", a, b) for a, b in merged}
        out |= {(*k, "gap", a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, data, schema=SCHEMA, **kw):
    df = cover(spark.createDataFrame(data, schema), ["field_id", "chrom"], "s", "e", **kw)
    got = [tuple(r) for r in df.select("field_id", "chrom", "kind", "range_start", "range_end").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_touching_nested_and_gapped(spark):
    data = [(1, "a", 1, 5), (1, "a", 6, 7), (1, "a", 2, 3), (1, "a", 10, 12), (2, "a", 4, 4)]
    assert run(spark, data) == {
        (1, "a", "period", 1, 7), (1, "a", "gap", 8, 9), (1, "a", "period", 10, 12), (2, "a", "period", 4, 4),
    }


def test_nulls_reversed_repeats_and_limits(spark):
    data = [
        (None, "a", 1, 2), (None, "a", 4, 5), (1, None, 3, 3), (1, "a", None, 4), (1, "a", 4, None), (1, "a", 9, 3),
        (1, "a", 0, 2147483647), (1, "a", 0, 2147483647), (2, "b", -5, -1), (2, "b", 1, 1),
    ]
    assert run(spark, data) == brute(data)
    assert (1, "a", "period", 0, 2147483647) in run(spark, data)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([(1, "a", 1, 2, 9, 9, "x")], SCHEMA + ", pos int, block int, kind string")
    out = cover(df, ["field_id", "chrom"], "s", "e")
    assert out.columns == ["field_id", "chrom", "kind", "range_start", "range_end"]
    assert [tuple(r) for r in out.collect()] == [(1, "a", "period", 1, 2)]


def test_hot_entity_across_many_blocks(spark):
    rnd = random.Random(3)
    data = [(1, "hot", s := rnd.randrange(100000), s + rnd.randrange(40)) for _ in range(3000)]
    data += [(1, "hot", 50, 90000)] * 50 + [(i, "x", i, i + 2) for i in range(20)]
    assert run(spark, data, block_bits=6) == brute(data)
    assert run(spark, data, block_bits=18) == brute(data)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from(["a", None]), st.integers(0, 60), st.integers(0, 60)), max_size=25), st.integers(1, 5))
def test_against_brute_force(spark, data, bits):
    assert run(spark, data, block_bits=bits) == brute(data)


def test_wide_coordinates_over_blocks_and_stretches(spark, monkeypatch):
    from strandmill.operators import cover as module

    wide = SCHEMA.replace("s int, e int", "s long, e long")
    year = 31_536_000_000_000  # microseconds
    rnd = random.Random(5)
    data = [(rnd.randrange(2), "t", s := rnd.randrange(-year, year), s + rnd.choice([0, 10**6, 10**11])) for _ in range(400)]
    assert run(spark, data, wide) == brute(data)
    monkeypatch.setattr(module, "STRETCH_BITS", 2)
    near = [(1, "t", s := rnd.randrange(-3000, 3000), s + rnd.choice([0, 1, 5, 700])) for _ in range(120)] + [(1, "t", -9000, -8999), (1, "t", 9000, 9000), (2, "t", 0, 9)]
    for bits in (1, 3, 6):
        assert run(spark, near, wide, block_bits=bits) == brute(near)


def test_coordinates_as_texts(spark):
    text = [(1, "a", "9", "10"), (1, "a", "2", "3"), (1, "a", "100", "20"), (1, "a", "x", "3"), (1, "a", None, "3")]
    assert run(spark, text, SCHEMA.replace("s int, e int", "s string, e string")) == brute([(1, "a", 9, 10), (1, "a", 2, 3)])
