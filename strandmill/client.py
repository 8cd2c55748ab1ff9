"""The usual questions to a catalog, each as one Spark plan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.catalog import ROW, Catalog
from strandmill.functions.output import respond
from strandmill.functions.scalars import nan_to_null, null_to_nan
from strandmill.plans.column_query import collected, column_query
from strandmill.plans.expression import run
from strandmill.plans.fetch import fetch, long_values


def post(catalog: Catalog, expression: str, accept: str = "application/json", names: dict[str, str] | None = None) -> str:
    """Evaluate an expression and answer in the format that is asked for."""
    return respond(run(expression, catalog=catalog, names=names), accept)


def _dataset(catalog: Catalog, **where) -> DataFrame:
    df = catalog.system("dataset")
    for k, v in where.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def _list(df: DataFrame) -> list:
    return [r[0] for r in collected(df)]


def cohorts_df(dataset: DataFrame) -> DataFrame:
    return dataset.where("cohort is not null").select("cohort").distinct()


def all_cohorts(catalog: Catalog) -> list[str]:
    """The cohorts that have datasets."""
    return _list(cohorts_df(catalog.system("dataset")))


def field_values_df(dataset: DataFrame, field: DataFrame, code: DataFrame, field_name: str) -> DataFrame:
    """Codes of the fields of a name, in the given datasets."""
    d = dataset.select(F.col("id").alias("d_id"))
    f = field.where(F.col("name") == field_name).select(F.col("id").alias("f_id"), "dataset_id")
    return d.join(f, F.col("d_id") == F.col("dataset_id")).join(code, F.col("field_id") == F.col("f_id")).select("value", "ordering")


def all_samples(catalog: Catalog, cohort: str) -> list[str]:
    """The samples of a cohort's datasets."""
    df = field_values_df(_dataset(catalog, cohort=cohort), catalog.system("field"), catalog.system("code"), "sampleID")
    return _list(df.select("value").distinct())


def datasets_list(catalog: Catalog) -> list[str]:
    return _list(catalog.system("dataset").select("name"))


def datasets_list_in_cohort(catalog: Catalog, cohort: str) -> list[str]:
    return _list(_dataset(catalog, cohort=cohort).select("name"))


def dataset_type(catalog: Catalog, dataset: str) -> list[str]:
    return _list(_dataset(catalog, name=dataset).select("type"))


def fields_df(dataset: DataFrame, field: DataFrame) -> DataFrame:
    """``dataset``, ``id``, ``field`` of all fields of the given datasets; repeated rows count once."""
    d = dataset.select(F.col("id").alias("d_id"), F.col("name").alias("dataset")).distinct()
    f = field.select("id", "dataset_id", F.col("name").alias("field")).distinct()
    return d.join(f, F.col("dataset_id") == F.col("d_id")).select("dataset", "id", "field")


def dataset_field(catalog: Catalog, dataset: str) -> list[str]:
    """The fields of a dataset."""
    return _list(fields_df(_dataset(catalog, name=dataset), catalog.system("field")).orderBy("id").select("field"))


def with_flags(field: DataFrame, **tables: DataFrame) -> DataFrame:
    """The ids of the fields, and for each table whether it has rows of the field: ``id``, ``has_<table>``."""
    out = field.select("id").distinct()
    for name, rows in tables.items():
        have = rows.select(F.col("field_id").alias("__f")).distinct().withColumn("__has", F.lit(True))
        out = out.join(have, F.col("id") == F.col("__f"), "left").withColumn(f"has_{name}", F.coalesce("__has", F.lit(False))).drop("__f", "__has")
    return out


def dataset_samples(catalog: Catalog, dataset: str) -> list[str]:
    """The samples of a dataset, in the order of their codes."""
    df = field_values_df(_dataset(catalog, name=dataset), catalog.system("field"), catalog.system("code"), "sampleID")
    return _list(df.orderBy("ordering").select("value"))


def dataset_probe_values(catalog: Catalog, dataset: str, samples: list[str], probes: list[str]) -> list[list[float]]:
    """A row per probe, a column per sample."""
    return fetch(catalog, [{"table": dataset, "columns": probes, "samples": samples}])


def probes_of_genes(catalog: Catalog, probemap: str, genes: list[str]) -> DataFrame:
    """``gene`` (as asked), ``name``, ``__row``: the probes of each gene; letter case makes no difference."""
    ds = catalog.dataset(probemap)
    wanted = catalog.spark.createDataFrame([(i, g, g.lower()) for i, g in enumerate(genes)], "gene_no int, gene string, low string")
    each = ds.columns(["name", "genes"]).select(ROW, "name", F.explode(F.array_distinct(F.transform("genes", F.lower))).alias("low"))
    return each.join(wanted, "low").select("gene_no", "gene", "name", ROW)


def probemap_of(catalog: Catalog, dataset: str) -> str:
    return str(catalog.dataset(dataset).meta.get("metadata", {}).get("probeMap", "")).lstrip("/")


def dataset_gene_probes_values(catalog: Catalog, dataset: str, samples: list[str], gene: str) -> list:
    """The probes of a gene, and their values."""
    q = {"select": ["name"], "from": [probemap_of(catalog, dataset)], "where": ["in", "any", "genes", [gene]]}
    probes = [r["name"] for r in column_query(catalog, q).collect()]
    return [probes, dataset_probe_values(catalog, dataset, samples, probes)]


def gene_scores(probes: DataFrame, values: DataFrame) -> DataFrame:
    """Mean over a gene's probes at each slot, missing values left out: ``gene_no``, ``pos``, ``__row``, ``score``.

    ``probes``: ``gene_no``, ``name``; ``values``: ``name``, ``pos``, ``__row``, ``value``. One aggregation for all genes.
    """
    both = probes.select("gene_no", "name").join(values, "name")
    return both.groupBy("gene_no", "pos", ROW).agg(null_to_nan(F.avg(nan_to_null(F.col("value").cast("double")))).alias("score"))


def dataset_gene_values(catalog: Catalog, dataset: str, samples: list[str], genes: list[str]) -> list[dict]:
    """Per gene the mean of its probes for each sample; a gene without probes has ``[[]]``."""
    probes = probes_of_genes(catalog, probemap_of(catalog, dataset), genes).cache()
    try:
        names = sorted({r["name"] for r in probes.select("name").distinct().collect()})
        if not names:
            return [{"gene": g, "scores": [[]]} for g in genes]
        ids = catalog.spark.createDataFrame(list(enumerate(names)), "col int, name string")
        values = long_values(catalog, dataset, names, samples).join(ids, "col")
        rows = gene_scores(probes, values).orderBy("gene_no", "pos", ROW).collect()
    finally:
        probes.unpersist()
    by: dict[int, list[float]] = {}
    for r in rows:
        by.setdefault(r["gene_no"], []).append(r["score"])
    return [{"gene": g, "scores": [by[i]] if i in by else [[]]} for i, g in enumerate(genes)]


def samples_by_field_df(catalog: Catalog, names: list[str], field: str, values: list) -> DataFrame:
    """``dataset``, ``sampleID`` of the samples that have one of ``values`` in ``field``, over several datasets in one plan."""
    out = catalog.spark.createDataFrame([], "dataset string, sampleID string")
    for name in names:
        ds = catalog.dataset(name)
        if field in ds.fields and "sampleID" in ds.fields:
            q = {"select": ["sampleID"], "from": [name], "where": ["in", field, values]}
            out = out.unionByName(column_query(catalog, q, ordered=False).select(F.lit(name).alias("dataset"), F.col("sampleID").cast("string").alias("sampleID")))
    return out


def find_samples_by_field(catalog: Catalog, cohort: str, field: str, values: list) -> dict[str, list[str]]:
    """The samples of a cohort that have one of ``values`` in ``field``, over all its datasets."""
    found = samples_by_field_df(catalog, datasets_list_in_cohort(catalog, cohort), field, values)
    return {cohort: _list(found.select("sampleID").distinct().orderBy("sampleID"))}


def patient_samples(catalog: Catalog, cohort: str, patients: list[str]) -> dict[str, list[str]]:
    return find_samples_by_field(catalog, cohort, "_PATIENT", patients)


def codes_in_order(catalog: Catalog, dataset: str, field: str) -> str | None:
    """The states of a field in their order, separated by tabs."""
    codes = catalog.dataset(dataset).codes
    if codes is None:
        return None
    row = codes.where(F.col("field") == field).agg(F.expr("listagg(value, '\\t') WITHIN GROUP (ORDER BY ordering)").alias("v")).first()
    return row["v"]


def expression_json(catalog: Catalog, expression: str):
    """The JSON answer, decoded."""
    return json.loads(post(catalog, expression))
