"""Datasets and the system tables that describe them.

A dataset is a virtual table with an observable row order (``__row``). Tabular
datasets keep one column per field. Matrix datasets can have hundreds of
thousands of fields, so they keep one *row* per field, with the values of all
samples in an array; nothing ever builds a plan with that many columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.session import written

ROW = "__row"

SYSTEM = {
    "dataset": "id int, name string, probemap string, shorttitle string, longtitle string, grouptitle string, platform string, "
    "cohort string, security string, rows int, status string, text string, type string, datasubtype string",
    "field": "id int, dataset_id int, name string",
    "code": "id int, field_id int, ordering int, value string",
    "feature": "id int, field_id int, shorttitle string, longtitle string, priority double, valuetype string, visibility string",
    "field_position": "field_id int, row int, bin int, chrom string, chromstart int, chromend int, strand string",
    "field_gene": "field_id int, row int, gene string",
    "source": "id int, name string, time timestamp, hash string",
    "dataset_source": "dataset_id int, source_id int",
    "field_score": "field_id int, row int, value float",
}


class UnknownDataset(KeyError):
    """No dataset has this name."""


class UnknownSymbol(NameError):
    """An expression names something that has no value."""


class QueryError(ValueError):
    """A query is malformed or asks for something that isn't allowed."""


class LoadError(ValueError):
    """A file can't be loaded."""


@dataclass
class Field:
    """A field and its type: float, category, genes or position."""

    name: str
    type: str
    id: int = 0
    feature: dict = field(default_factory=dict)


@dataclass
class Dataset:
    """``df`` holds the fields as columns and ``__row``; a matrix has ``values``
    (``field``, ``values`` array, ``codes`` array) and ``samples`` (``sample``, ``__row``) instead.
    ``codes``: ``field``, ``ordering``, ``value``."""

    name: str
    fields: dict[str, Field]
    df: DataFrame | None = None
    values: DataFrame | None = None
    samples: DataFrame | None = None
    codes: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    @property
    def is_matrix(self) -> bool:
        return self.values is not None

    def columns(self, names: list[str]) -> DataFrame:
        """``__row`` and the named fields; fields the dataset lacks are NULL."""
        known = [n for n in names if n in self.fields]
        if not self.is_matrix:
            df = self.df
            return df.select(
                ROW, *[(F.col(f"`{n}`") if n in known else F.lit(None).cast("string").alias(n)) for n in dict.fromkeys(names)]
            )
        wanted = [n for n in dict.fromkeys(names) if n != "sampleID"]
        base = self.samples.select(ROW, F.col("sample").alias("sampleID"))
        cells = [n for n in wanted if n in known]
        if cells:
            # the filter on the field reaches the scan; the pivot's columns are known, so it costs no extra job
            long = self.values.where(F.col("field").isin(cells)).select(
                "field", F.posexplode(F.arrays_zip("values", "codes")).alias(ROW, "v")
            )
            kinds = {n: self.fields[n].type for n in cells}
            wide = long.groupBy(ROW).agg(
                *[
                    F.first(F.when(F.col("field") == n, F.col("v.values" if kinds[n] == "float" else "v.codes")), ignorenulls=True).alias(n)
                    for n in cells
                ]
            )
            base = base.join(wide, ROW, "left")
        out = base.select(
            ROW,
            *(["sampleID"] if "sampleID" in names else []),
            *[(F.col(f"`{n}`") if n in cells else F.lit(None).cast("string").alias(n)) for n in wanted],
        )
        return out.select(ROW, *[F.col(f"`{n}`") for n in dict.fromkeys(names)])


def guess_type(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return "genes"
    if isinstance(t, T.StructType):
        return "position"
    return "float" if isinstance(t, T.NumericType) else "category"


def with_rows(df: DataFrame, *order: str) -> DataFrame:
    """Number the rows densely from 0 in the given order.

    The frame is range-partitioned and sorted, rows are numbered within each
    partition, and the sizes of earlier partitions are added; no task sees more
    than its own partition. The sorted rows are written to the shared folder
    once, because the bounds of the ranges may differ when they are computed
    again. Ties are numbered either way, but once and for all.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(
        ranged.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()), "rows"
    )
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__size"), F.min("__place").alias("__least"))
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("__part", "__least", F.coalesce(before, F.lit(0)).alias("__before"))
    # one row per partition of the frame, so its size is bounded by the number of partitions
    return (
        numbered.join(F.broadcast(base), "__part")
        .withColumn(ROW, (F.col("__place") - F.col("__least") + F.col("__before")).cast("long"))
        .drop("__part", "__place", "__least", "__before")
    )


class Catalog:
    """Datasets by name, and the system tables as views."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.datasets: dict[str, Dataset] = {}
        self.tables: dict[str, DataFrame] = {}
        self._next = {"dataset": 1, "field": 1}

    # -- registration ----------------------------------------------------
    def register(
        self, name: str, df: DataFrame, order: list[str] | None = None, types: dict[str, str] | None = None, row: str | None = None, **meta
    ) -> Dataset:
        """A tabular dataset over any DataFrame.

        Its row order is the column ``__row`` if there is one, else the
        expression ``row`` (a unique number that gives the order, which needs
        no shuffle), else rows are numbered by ``order``.
        """
        if ROW not in df.columns:
            df = df.withColumn(ROW, F.expr(row).cast("long")) if row else with_rows(df, *(order or df.columns))
        fields = {
            f.name: Field(f.name, (types or {}).get(f.name) or guess_type(f.dataType)) for f in df.schema.fields if f.name != ROW
        }
        return self.add(Dataset(name, fields, df=df, meta=meta))

    def add(self, ds: Dataset) -> Dataset:
        """Put a dataset in, in place of one of the same name; ids are new."""
        ds.meta.setdefault("id", self._take("dataset"))
        for f in ds.fields.values():
            f.id = f.id or self._take("field")
        self.datasets[ds.name] = ds
        return ds

    def _take(self, kind: str) -> int:
        n = self._next[kind]
        self._next[kind] = n + 1
        return n

    def delete(self, name: str) -> bool:
        """Forget a dataset; False if there is none."""
        return self.datasets.pop(name, None) is not None

    def dataset(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise UnknownDataset(name)
        return self.datasets[name]

    # -- system tables -----------------------------------------------------
    def use_tables(self, **tables: DataFrame) -> None:
        """System tables that exist already take the place of those made from the datasets."""
        self.tables |= tables

    def system(self, name: str) -> DataFrame:
        """One of the system tables; column names are lower case."""
        if name in self.tables:
            return self.tables[name]
        make = getattr(self, f"_{name}", None)
        rows = make() if make else []
        return rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, SYSTEM[name])

    def names(self) -> set[str]:
        """The tables that :meth:`system` knows."""
        return {*SYSTEM, *self.tables}

    def _dataset(self) -> list[tuple]:
        import json

        keys = ("probeMap", "shortTitle", "longTitle", "groupTitle", "platform", "cohort", "security")
        return [
            (
                d.meta["id"], d.name, *[_text(d.meta.get("metadata", {}).get(k)) for k in keys], d.meta.get("rows"), d.meta.get("status", "loaded"),
                json.dumps(d.meta.get("metadata", {})), _text(d.meta.get("metadata", {}).get("type")), _text(d.meta.get("metadata", {}).get("dataSubType")),
            )
            for d in self.datasets.values()
        ]

    def _field(self) -> list[tuple]:
        return [(f.id, d.meta["id"], f.name) for d in self.datasets.values() for f in d.fields.values()]

    def _feature(self) -> list[tuple]:
        out = []
        for d in self.datasets.values():
            for f in d.fields.values():
                if f.feature or f.type == "category":
                    x = f.feature
                    priority = x.get("priority")
                    out.append(
                        (f.id, f.id, x.get("shortTitle"), x.get("longTitle"), float(priority) if priority else None, f.type, x.get("visibility"))
                    )
        return out

    def _source(self) -> list[tuple]:
        return [s for s, _ in self._sources()]

    def _dataset_source(self) -> list[tuple]:
        return [(d, s[0]) for s, ds in self._sources() for d in ds]

    def _sources(self) -> list[tuple[tuple, list[int]]]:
        by: dict[tuple, list[int]] = {}
        for d in self.datasets.values():
            for s in d.meta.get("sources", []):
                by.setdefault((s["name"], s["time"], s["hash"]), []).append(d.meta["id"])
        return [((i + 1, *k), v) for i, (k, v) in enumerate(by.items())]

    def _union(self, name: str, parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SYSTEM[name])

    def _ids(self, d: Dataset) -> DataFrame:
        return self.spark.createDataFrame([(f.name, f.id) for f in d.fields.values()], "field string, field_id int")

    def _code(self) -> DataFrame:
        parts = [
            d.codes.join(self._ids(d), "field").select(
                F.xxhash64("field_id", "ordering").cast("int").alias("id"), "field_id", F.col("ordering").cast("int").alias("ordering"), "value"
            )
            for d in self.datasets.values()
            if d.codes is not None
        ]
        return self._union("code", parts)

    def _field_position(self) -> DataFrame:
        from strandmill.functions.scalars import calc_bin

        parts = []
        for d in self.datasets.values():
            for f in d.fields.values():
                if f.type == "position" and d.df is not None:
                    p = lambda k, n=f.name: F.col(f"`{n}`.`{k}`")
                    parts.append(
                        d.df.select(
                            F.lit(f.id).alias("field_id"), F.col(ROW).cast("int").alias("row"), calc_bin(p("chromStart"), p("chromEnd")).cast("int").alias("bin"),
                            p("chrom").alias("chrom"), p("chromStart").alias("chromstart"), p("chromEnd").alias("chromend"), p("strand").alias("strand"),
                        )
                    )
        return self._union("field_position", parts)

    def _field_gene(self) -> DataFrame:
        parts = [
            d.df.select(F.lit(f.id).alias("field_id"), F.col(ROW).cast("int").alias("row"), F.explode(F.col(f"`{f.name}`")).alias("gene"))
            for d in self.datasets.values()
            for f in d.fields.values()
            if f.type == "genes" and d.df is not None
        ]
        return self._union("field_gene", parts)


def _text(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else str(v)
