"""Sample-aligned values: ``{table, columns, samples}`` in the order that is asked for."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.catalog import ROW, Catalog, Dataset
from strandmill.plans.column_query import part, word

NAN = float("nan")


def gather(keys: DataFrame, rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Ordered gather: every wanted key, in its place, with all its rows; a key without rows has one of NULLs.

    ``keys`` has ``pos`` and ``key``. The order is that of ``pos`` and ``__row``.
    """
    return keys.join(rows, key, "left").orderBy(pos, ROW)


def wanted(ds: Dataset, samples: list) -> DataFrame:
    spark = (ds.df if ds.df is not None else ds.values).sparkSession
    return spark.createDataFrame([(i, None if s is None else str(s)) for i, s in enumerate(samples)], "pos int, sampleID string")


def long_values(catalog: Catalog, table: str, columns: list[str], samples: list) -> DataFrame:
    """``col`` (place in ``columns``), ``pos``, ``__row``, ``value``: one row per column and slot.

    A slot is a sample, or each row of a sample that has several. Category
    fields give their codes; fields that are unknown or have no number in a
    cell, and samples that are unknown, give NaN.
    """
    ds = catalog.dataset(table)
    slots = wanted(ds, samples)
    if ds.is_matrix:
        if not columns:
            return catalog.spark.createDataFrame([], f"col int, pos int, {ROW} long, value double")
        # the places of the samples that are asked for, as many as the request names; cells are then taken by
        # their place in the field's array, so of a field with any number of samples only these leave the scan
        rows = ds.samples.withColumnRenamed("sample", "sampleID")
        placed = [(r["pos"], r[ROW]) for r in gather(slots, rows, "sampleID").select("pos", ROW).collect()]
        spots = F.from_json(F.lit(json.dumps([{"pos": p, ROW: r} for p, r in placed])), f"array<struct<pos: int, {ROW}: long>>")
        names = catalog.spark.createDataFrame(list(enumerate(columns)), "col int, field string")
        cells = ds.values.where(F.col("field").isin([c for c in columns if c in ds.fields]))
        at = lambda a, x: F.get(a, x[ROW].cast("int"))  # noqa: E731 - NULL for a sample that is unknown
        filled = F.transform(spots, lambda x: F.struct(x["pos"].alias("pos"), x[ROW].alias(ROW), at(F.col("values"), x).alias("value"), at(F.col("codes"), x).alias("text")))
        out = names.join(cells, "field", "left").select("col", "field", F.explode(filled).alias("x")).select(
            "col", "field", "x.pos", f"x.{ROW}", F.col("x.value").cast("double").alias("value"), "x.text"
        )
    else:
        known = [c for c in columns if c in ds.fields and ds.fields[c].type in ("float", "category")]
        if "sampleID" in ds.fields:
            rows = ds.columns(list(dict.fromkeys(["sampleID", *known])))
            rows = rows.withColumn("sampleID", F.col("sampleID").cast("string"))
        else:
            rows = ds.columns(known).withColumn("sampleID", F.lit(None).cast("string"))
        placed = slots.join(rows, "sampleID", "left") if "sampleID" in ds.fields else slots.withColumn(ROW, F.lit(None).cast("long"))

        def cell(i: int, c: str):
            kind = ds.fields[c].type if c in known and "sampleID" in ds.fields else None
            number = F.col(f"`{c}`").try_cast("double") if kind == "float" else F.lit(None).cast("double")
            text = F.col(f"`{c}`").cast("string") if kind == "category" else F.lit(None).cast("string")
            return F.struct(F.lit(i).alias("col"), F.lit(c).alias("field"), number.alias("value"), text.alias("text"))

        if not columns:
            return catalog.spark.createDataFrame([], f"col int, pos int, {ROW} long, value double")
        out = placed.select("pos", ROW, F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns)])).alias("x")).select(
            "x.col", "x.field", "pos", ROW, "x.value", "x.text"
        )
    coded = [c for c in columns if c in ds.fields and ds.fields[c].type == "category"]
    if coded and ds.codes is not None:
        codes = ds.codes.where(F.col("field").isin(coded)).select("field", F.col("value").alias("text"), F.col("ordering").cast("double").alias("o"))
        out = out.join(codes, ["field", "text"], "left").withColumn("value", F.coalesce("value", "o"))
    return out.select("col", "pos", ROW, F.coalesce("value", F.lit(NAN)).alias("value"))


def fetch(catalog: Catalog, requests) -> list[list[float]]:
    """A list of vectors, one per request and column, in the order of the requests."""
    if isinstance(requests, dict):
        requests = [requests]
    out = []
    for r in requests:
        columns = [word(c) for c in part(r, "columns") or []]
        samples = list(part(r, "samples") or [])
        df = long_values(catalog, word(part(r, "table")), columns, samples)
        by = df.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(ROW, F.lit(-1)).alias("r"), "value"))).alias("v"))
        got = {row["col"]: [x["value"] for x in row["v"]] for row in by.collect()}
        out += [got.get(i, []) for i in range(len(columns))]
    return out


def fetch_df(catalog: Catalog, requests) -> DataFrame:
    """The same as a DataFrame: ``req``, ``col``, ``pos``, ``__row``, ``value``."""
    parts = []
    for i, r in enumerate(requests if isinstance(requests, (list, tuple)) else [requests]):
        df = long_values(catalog, word(part(r, "table")), [word(c) for c in part(r, "columns") or []], list(part(r, "samples") or []))
        parts.append(df.select(F.lit(i).alias("req"), "*"))
    return reduce(DataFrame.unionByName, parts)
