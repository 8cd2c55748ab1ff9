"""The text queries on the smallest test tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_registered():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries())


def test_leaks(spark):
    found = {tuple(r) for r in Q.p6_found(spark, SF).collect()}
    spans = {r["doc_id"] for r in Q.p6_spans(spark, SF).collect()}
    assert spans == {d for _, d in found}
    left = {r["doc_id"]: r["n_chars"] for r in Q.p6_clean(spark, SF).collect()}
    docs = {r["doc_id"]: r["n"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.length("text").alias("n")).collect()}
    assert set(left) == set(docs) and {d for d in docs if left[d] != docs[d]} == spans


def test_mixture(spark):
    shares = Q.p7_shares(spark, SF).collect()
    assert len(shares) == 31 and all(r["most_repeats"] <= r["max_repeats"] for r in shares)
    for plan in (1, 2, 3):
        assert abs(sum(r["reached_share"] for r in shares if r["plan_id"] == plan) - 1) < 1e-9
    mix = Q.p7_mix(spark, SF)
    assert mix.count() == mix.select("plan_id", "doc_id").distinct().count()


def test_languages(spark):
    found = Q.p8_found(spark, SF)
    assert found.where("lang is null").count() == 0 and found.count() == found.distinct().count()
    mixed = Q.p8_languages(spark, SF).where("seg_no > 0").groupBy("doc_id").agg(F.countDistinct("lang").alias("n"))
    assert mixed.where("n < 2").count() == 0
