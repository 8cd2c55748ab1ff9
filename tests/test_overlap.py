"""Joins of intervals whose coordinates are beyond 32 bits."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from strandmill import queries
from strandmill.operators.overlap import _home, overlap_join

NEAR = [0, 21_474, 214_748, 480_000, 1_199_999, 90_000_000_000]  # genes: keys times 10 000, around 2^31 and far beyond it


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The folder of small tables with large keys, and the same tables in DuckDB."""
    at = tmp_path_factory.mktemp("far")
    parts = [(k + d, (7 * i + d) % 50 + 1) for i, k in enumerate(NEAR) for d in range(30)]
    lines = [(i, 10 * k + d - 5, 22 * d + (k + d // 10 + e) % 22, e, float(1 + (d * 13 + e) % 50)) for i, k in enumerate(NEAR) for d in range(5, 300, 3) for e in range(3)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    db = duckdb.connect()
    for t in ("part", "lineitem"):
        db.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    return str(at), db


@pytest.mark.parametrize("name", ["interval_join", "interval_semi_join", "position_overlap", "calc_bin", "overlapping_bins"])
def test_keys_beyond_32_bits(spark, far, name):
    at, db = far
    df = queries.QUERIES[name](spark, at)
    cur = db.execute(queries.SQL[name])
    got, want = df.select([d[0] for d in cur.description]).collect(), cur.fetchall()
    assert Counter(map(tuple, got)) == Counter(want) and (len(want) > 100 or name == "position_overlap")


def test_overlaps_across_bins_of_every_level(spark):
    edges = [s * (1 << b) for b in (17, 29, 31, 32, 37, 45, 53, 60) for s in (1, 3)] + [-(1 << 40)]
    A = [(i, "a", e - i % 3, e + i % 2) for i, e in enumerate(edges)]
    B = [(j, "a", e + d, e + d + 3) for j, (e, d) in enumerate((e, d) for e in edges for d in (-5, -2, 0, 1, 2))]
    left, right = spark.createDataFrame(A, "i int, c string, s long, e long"), spark.createDataFrame(B, "j int, c2 string, s2 long, e2 long")
    got = overlap_join(left, right, ("c", "c2"), ("s", "e"), ("s2", "e2"))
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, _, s, e in A for j, _, x, y in B if s <= y and e >= x)


def test_far_intervals_do_not_share_one_bin(spark):
    """Intervals across edges of 2^29 are spread as the coordinates grow."""
    df = spark.range(1, 4097).selectExpr("shiftleft(id, 29) - 1 as s", "shiftleft(id, 29) as e")
    most = df.groupBy(_home(F.col("s"), F.col("e")).alias("h")).count().agg(F.max("count")).first()[0]
    assert most <= 256


@pytest.mark.parametrize("name", ["interval_join", "interval_semi_join"])
def test_exploded_side_is_not_broadcast(spark, far, name):
    """Its rows are many times those of the table that the planner knows the size of."""
    plan = queries.QUERIES[name](spark, far[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
