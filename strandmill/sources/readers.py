"""Readers of tab-separated files: matrices, clinical tables and files of positions.

A reader turns a file into a :class:`~strandmill.catalog.Dataset`. Only the
header, a few lines for guessing types and per-field summaries reach the
driver; the cells stay on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.catalog import ROW, Dataset, Field, LoadError, with_rows
from strandmill.functions.scalars import MISSING_NUMBERS, normalize_chrom, parse_coordinate, parse_float_na, shift_int_csv, split_genes
from strandmill.operators.aggregates import rank_in_group, suffixed

MAX_NAME = 250


@dataclass
class Parsed:
    dataset: Dataset
    warnings: dict = field(default_factory=dict)


# -- lines ------------------------------------------------------------------------
def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order: ``__b`` and ``__m`` order them, ``line`` is the text."""
    return spark.read.text(path).select(
        F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"), F.regexp_replace("value", "\r$", "").alias("line")
    )


def tabbed(c: Column) -> Column:
    """Cells of a line: split at tabs, trimmed, without any quote sign."""
    return F.transform(F.split(c, "\t", -1), lambda x: F.replace(F.trim(x), F.lit('"'), F.lit("")))


def first_line(df: DataFrame, blank: bool = False) -> tuple | None:
    """The first line (that isn't blank): its place and its text."""
    some = df if blank else df.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    return next(iter(some.orderBy("__b", "__m").take(1)), None)


def py_tabbed(line: str) -> list[str]:
    return [c.strip().replace('"', "") for c in line.split("\t")]


def after(df: DataFrame, head) -> DataFrame:
    return df.where((F.col("__b") > head["__b"]) | ((F.col("__b") == head["__b"]) & (F.col("__m") > head["__m"])))


# -- names --------------------------------------------------------------------------
def unique_names(names: list[str]) -> list[str]:
    """``x``, ``x (2)``, ``x (3)`` ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n} ({seen[n]})")
    return out


def number_names(df: DataFrame, name: str, *order: str, within: list[str] | None = None) -> DataFrame:
    """Field names cut to ``MAX_NAME`` characters; repeated ones get `` (n)`` in the given order, which is that of the file.

    Adds ``field``, ``__long`` and ``__dup``. Names are numbered over the whole
    frame, or among the rows with the same values of ``within``.
    """
    cut = df.withColumn("__cut", F.substring(name, 1, MAX_NAME)).withColumn("__long", F.length(name) > MAX_NAME)
    ranked = rank_in_group(cut, [*(within or []), "__cut"], list(order), "__n")
    return ranked.withColumn("field", suffixed(F.col("__cut"), F.col("__n"))).withColumn("__dup", F.col("__n") > 1).drop("__n", "__cut")


# -- matrices -----------------------------------------------------------------------
def is_float(c: Column) -> Column:
    return c.isin(*MISSING_NUMBERS) | c.try_cast("float").isNotNull()


def read_matrix(spark: SparkSession, path: str, name: str, features: dict[str, dict] | None = None) -> Parsed:
    """A matrix of fields (rows) by samples (columns).

    The first header cell is the sample id whatever it says. Short rows are
    filled with missing values, long rows are cut. Of a sample that is listed
    twice the first column counts. A field is float if all its cells are
    numbers or missing, else category; a feature's ``valueType`` decides first.
    """
    features = features or {}
    text = lines(spark, path).where(F.col("line") != "")
    head = first_line(text)
    if head is None:
        raise LoadError(f"{path} is empty")
    header = py_tabbed(head["line"])
    keep, seen, repeated = [], set(), []
    for i, s in enumerate(header[1:], 1):
        (repeated.append(s) if s in seen else keep.append(i))
        seen.add(s)
    samples = [header[i] for i in keep]
    cells = tabbed(F.col("line"))
    places = F.array(*[F.lit(i) for i in keep]) if len(keep) < len(header) - 1 else None
    width = len(header)
    padded = F.transform(F.sequence(F.lit(1), F.lit(width - 1)), lambda i: F.coalesce(F.get("__c", i), F.lit(""))) if width > 1 else F.array().cast("array<string>")
    rows = (
        after(text, head)
        .withColumn("__c", cells)
        .select("__b", "__m", F.get("__c", F.lit(0)).alias("__name"), padded.alias("__all"))
        .withColumn("__v", F.transform(places, lambda i: F.get("__all", i - 1)) if places is not None else F.col("__all"))
    )
    named = number_names(rows, "__name", "__b", "__m")
    declared = {k: v.get("valueType") for k, v in features.items() if v.get("valueType") in ("float", "category")}
    kind = F.when(F.forall("__v", is_float), "float").otherwise("category")
    if declared:
        given = F.try_element_at(F.create_map(*[F.lit(x) for kv in declared.items() for x in kv]), F.col("__name"))
        wrong = named.where((given == "float") & ~F.forall("__v", is_float)).select("field").take(1)
        if wrong:
            raise LoadError(f"field {wrong[0][0]} is declared as float and isn't")
        kind = F.coalesce(given, kind)
    typed = named.withColumn("type", kind)
    values = typed.select(
        "field",
        F.col("__name").alias("raw_name"),
        "type",
        F.when(F.col("type") == "float", F.transform("__v", parse_float_na)).otherwise(F.transform("__v", lambda x: F.lit(None).cast("float"))).alias("values"),
        F.when(F.col("type") == "category", F.transform("__v", lambda x: F.when(x != "", x))).otherwise(F.transform("__v", lambda x: F.lit(None).cast("string"))).alias("codes"),
        "__long",
        "__dup",
    )
    sample_df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], f"{ROW} long, sample string")
    return Parsed(Dataset(name, {}, values=values, samples=sample_df, meta={"features": features, "rows": len(samples)}), {"duplicate-keys": {"sampleID": repeated}} if repeated else {})


def finish_matrix(parsed: Parsed, values: DataFrame) -> Parsed:
    """Fields, codes and warnings of a matrix, once its cells are stored.

    The names and types of the fields go to the catalog on the driver.
    """
    ds, features = parsed.dataset, parsed.dataset.meta["features"]
    ds.values = values.select("field", "values", "codes")
    info = values.select("field", "raw_name", "type", "__long", "__dup").collect()
    ds.fields = {"sampleID": Field("sampleID", "category")}
    for r in info:
        ds.fields[r["field"]] = Field(r["field"], r["type"], feature=features.get(r["raw_name"], {}))
    if long := [r["field"] for r in info if r["__long"]]:
        parsed.warnings["too-long-probes"] = long
    if dup := [r["field"] for r in info if r["__dup"]]:
        parsed.warnings["duplicate-probes"] = dup
    ds.codes = matrix_codes(ds)
    return parsed


def matrix_codes(ds: Dataset) -> DataFrame:
    """``field``, ``ordering``, ``value``: declared orders, else the order of first occurrence among the samples."""
    spark = ds.values.sparkSession
    ids = ds.samples.select(F.lit("sampleID").alias("field"), F.col(ROW).cast("int").alias("ordering"), F.col("sample").alias("value"))
    orders = {n: f.feature["order"] for n, f in ds.fields.items() if f.type == "category" and f.feature.get("order")}
    free = [n for n, f in ds.fields.items() if f.type == "category" and n not in orders and n != "sampleID"]
    out = ids
    if orders:
        rows = [(n, i, s) for n, o in orders.items() for s, i in o.items()]
        declared = spark.createDataFrame(rows, "field string, ordering int, value string")
        used = ds.values.where(F.col("field").isin(list(orders))).select("field", F.explode("codes").alias("value")).where("value is not null").distinct()
        bad = used.join(declared, ["field", "value"], "left_anti").take(1)
        if bad:
            raise LoadError(f"Invalid state {bad[0]['value']} for feature {bad[0]['field']}")
        out = out.unionByName(declared)
    if free:
        some = ds.values.where(F.exists("codes", lambda x: x.isNotNull()) & ~F.col("field").isin(list(orders)))
        firsts = (
            some.select("field", F.posexplode("codes").alias("p", "value")).where("value is not null").groupBy("field", "value").agg(F.min("p").alias("p"))
        )
        ranked = rank_in_group(firsts, ["field"], ["p", "value"], "__n")
        out = out.unionByName(ranked.select("field", (F.col("__n") - 1).cast("int").alias("ordering"), "value"))
    return out


def read_clinical(spark: SparkSession, path: str, name: str, features: dict[str, dict] | None = None) -> Parsed:
    """A table of samples (rows) by phenotypes (columns), the width given by the first line."""
    features = features or {}
    text = lines(spark, path).where(F.col("line") != "")
    head = first_line(text)
    if head is None:
        raise LoadError(f"{path} is empty")
    header = py_tabbed(head["line"])
    names = unique_names([h[:MAX_NAME] for h in header[1:]])
    warnings: dict = {}
    if dup := [h for h, n in zip(header[1:], names) if h[:MAX_NAME] != n]:
        warnings["duplicate-probes"] = dup
    rows = after(text, head).withColumn("__c", tabbed(F.col("line")))
    cols = [F.coalesce(F.get("__c", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(len(header))]
    raw = rows.select("__b", "__m", *cols)
    # the first row of a sample counts
    firsts = raw.groupBy(F.col("c0").alias("__id")).agg(F.min(F.struct("__b", "__m")).alias("__first"), F.count("*").alias("__copies"))
    repeated = [r[0] for r in firsts.where("__copies > 1").select("__id").take(10)]
    if repeated:
        warnings["duplicate-keys"] = {"sampleID": repeated}
    raw = raw.join(firsts, (F.col("c0") == F.col("__id")) & (F.struct("__b", "__m") == F.col("__first"))).select(raw["*"])
    numeric = raw.agg(*[F.every(is_float(F.col(f"c{i}"))).alias(f"c{i}") for i in range(1, len(header))]).first() if len(header) > 1 else {}
    fields = {"sampleID": Field("sampleID", "category")}
    out = [F.col("c0").alias("sampleID")]
    for i, n in enumerate(names, 1):
        f = features.get(header[i], {})
        kind = f.get("valueType") if f.get("valueType") in ("float", "category") else ("float" if numeric[f"c{i}"] is not False else "category")
        if kind == "float" and numeric[f"c{i}"] is False:
            raise LoadError(f"field {n} is declared as float and isn't")
        fields[n] = Field(n, kind, feature=f)
        out.append((parse_float_na(F.col(f"c{i}")) if kind == "float" else F.when(F.col(f"c{i}") != "", F.col(f"c{i}"))).alias(n))
    df = with_rows(raw.select("__b", "__m", *out), "__b", "__m").drop("__b", "__m")
    return Parsed(Dataset(name, fields, df=df, meta={"features": features}), warnings)


# -- files of positions ---------------------------------------------------------------
#: fixed values: header names, in lower case without blanks, ``-`` and ``_``, by the names they stand for
MUTATION = {
    "sampleID": ("sample", "samplename", "sampleid"), "chrom": ("chr", "chrom"), "chromStart": ("start",), "chromEnd": ("end",), "genes": ("gene", "genes"),
    "alt": ("alt", "alternate"), "ref": ("ref", "reference"), "effect": ("effect",), "dna-vaf": ("dnavaf", "dnaaf"), "rna-vaf": ("rnavaf", "rnaaf"),
    "amino-acid": ("aminoacid", "aminoacidchange"),
}
SEGMENT = {
    "sampleID": ("sample", "samplename", "sampleid"), "chrom": ("chr", "chrom"), "chromStart": ("start",), "chromEnd": ("end",), "strand": ("strand",), "value": ("value",),
}
PROBEMAP = {
    "chrom": ("chr", "chrom"), "chromStart": ("start", "chromstart"), "chromEnd": ("end", "chromend"), "genes": ("gene", "genes"), "name": ("name", "id"),
    **{n: (n.lower(),) for n in ("strand", "thickStart", "thickEnd", "blockCount", "blockSizes", "blockStarts")},
}
GENEPRED = {
    "chrom": ("chr", "chrom"), "chromStart": ("txstart", "cdsstart"), "chromEnd": ("txend", "cdsend"),
    **{n: (n.lower(),) for n in ("bin", "name", "strand", "exonCount", "exonStarts", "exonEnds", "score", "name2", "cdsStartStat", "cdsEndStat", "exonFrames")},
}
#: fixed values: types of the names
KINDS = {
    "mutation": {"genes": "genes", "dna-vaf": "float", "rna-vaf": "float", **dict.fromkeys(("sampleID", "ref", "alt", "effect", "amino-acid"), "category")},
    "segment": {"sampleID": "category", "value": "float"},
    "probemap": {"genes": "genes", **dict.fromkeys(("name", "thickStart", "thickEnd", "blockCount", "blockSizes", "blockStarts"), "category")},
    "genepred": {
        "bin": "float", "exonCount": "float", "score": "float", "name2": "genes", "exonStarts": "starts",
        **dict.fromkeys(("name", "exonEnds", "cdsStartStat", "cdsEndStat", "exonFrames"), "category"),
    },
}
HEADERS = {"mutation": MUTATION, "segment": SEGMENT, "probemap": PROBEMAP, "genepred": GENEPRED}
FIRST = {"mutation": "sampleID"}
REQUIRED = {"mutation": ("sampleID", "position", "ref", "alt")}
POSITION = ("chrom", "chromStart", "chromEnd", "strand")


def canonical_header(cells: list[str], names: dict[str, tuple[str, ...]], first: str | None = None) -> list[str]:
    """The names that the cells of a header stand for; a cell that stands for none keeps its own."""
    known = {alias: name for name, aliases in names.items() for alias in aliases}
    out = [known.get(re.sub(r"[-_ ]", "", c.lower()), c) for c in cells]
    return [first, *out[1:]] if first and out else out


def collate_positions(header: list[str]) -> tuple[list[dict[str, int]], list[int]]:
    """Positions as ``part -> column``, and the columns left over.

    The n-th start goes with the n-th end; the last chromosome and strand serve
    all later positions.
    """
    by = {p: [i for i, h in enumerate(header) if h == p] for p in POSITION}
    count = max(map(len, by.values()), default=0)
    positions = []
    for n in range(count):
        at = {p: by[p][n] for p in ("chromStart", "chromEnd") if n < len(by[p])}
        at |= {p: by[p][min(n, len(by[p]) - 1)] for p in ("chrom", "strand") if by[p]}
        if {"chrom", "chromStart", "chromEnd"} <= set(at):
            positions.append(at)
    used = {i for p in positions for i in p.values()}
    return positions, [i for i in range(len(header)) if i not in used]


def read_map(spark: SparkSession, path: str, name: str, kind: str, start_index: int = 1) -> Parsed:
    """Mutations, segments, probe maps or gene predictions: positions first, then the other columns in file order.

    Blank lines and lines that start with ``#`` after the header are skipped.
    Columns that the format doesn't know are float if all their cells are
    numbers or missing, else category; a column that the format says is float
    must be so, or the load fails. With a position, rows are sorted by
    chromosome (as text) and start; ties keep the order of the file.
    """
    text = lines(spark, path)
    head = first_line(text)
    if head is None:
        raise LoadError(f"{path} is empty")
    header = canonical_header(py_tabbed(re.sub(r"^\s*#", "", head["line"])), HEADERS[kind], FIRST.get(kind))
    body = after(text, head).where((F.regexp_replace("line", r"\s+", "") != "") & ~F.col("line").rlike(r"^\s*#")).withColumn("__c", tabbed(F.col("line")))
    positions, others = collate_positions(header)
    if not positions and kind != "probemap":
        raise LoadError(f"{path} has no position")
    cell = lambda i: F.coalesce(F.get("__c", F.lit(i)), F.lit(""))
    # the types of all columns by one pass over all rows
    counted = [i for i in others if KINDS[kind].get(header[i]) in (None, "float")]
    numeric = body.agg(*[F.every(is_float(F.trim(cell(i)))).alias(f"c{i}") for i in counted]).first() if counted else {}
    shift = 1 if start_index == 0 else 0
    names = unique_names(["position"] * len(positions) + [header[i] for i in others])
    fields: dict[str, Field] = {}
    cols = []
    for n, at in zip(names, positions):
        strand = F.substring(F.trim(cell(at["strand"])), 1, 1) if "strand" in at else F.lit(".")
        cols.append(
            F.struct(
                normalize_chrom(cell(at["chrom"])).alias("chrom"), parse_coordinate(cell(at["chromStart"]), shift).alias("chromStart"),
                parse_coordinate(cell(at["chromEnd"])).alias("chromEnd"), F.when(strand == "", ".").otherwise(strand).alias("strand"),
            ).alias(n)
        )
        fields[n] = Field(n, "position")
    for n, i in zip(names[len(positions) :], others):
        k = KINDS[kind].get(header[i]) or ("category" if numeric[f"c{i}"] is False else "float")
        if k == "float" and numeric[f"c{i}"] is False:
            raise LoadError(f"field {n} has cells that are no numbers")
        fields[n] = Field(n, "category" if k == "starts" else k)
        v = parse_float_na(cell(i)) if k == "float" else split_genes(cell(i)) if k == "genes" else shift_int_csv(cell(i), shift) if k == "starts" else F.trim(cell(i))
        cols.append(v.alias(n))
    if missing := [r for r in REQUIRED.get(kind, ()) if r not in fields]:
        raise LoadError(f"Missing fields {' '.join(missing)}")
    df = body.select("__b", "__m", *cols)
    if positions:
        bad = df.where(F.col("position.chromStart").isNull() | F.col("position.chromEnd").isNull()).take(1)
        if bad:
            raise LoadError(f"{path} has a position without coordinates")
        df = df.withColumn("__pc", F.col("position.chrom")).withColumn("__ps", F.col("position.chromStart"))
        df = with_rows(df, "__pc", "__ps", "__b", "__m").drop("__pc", "__ps")
    else:
        df = with_rows(df, "__b", "__m")
    return Parsed(Dataset(name, fields, df=df.drop("__b", "__m")))


def table_codes(ds: Dataset) -> DataFrame | None:
    """Codes of the category fields of a table: declared orders, and no state outside of them, else the order of first occurrence.

    The fields without an order are folded and numbered together, in one pass.
    """
    spark = ds.df.sparkSession
    parts = []
    category = {n: f.feature.get("order") for n, f in ds.fields.items() if f.type == "category"}
    for n, order in category.items():
        if not order:
            continue
        part = spark.createDataFrame([(n, i, s) for s, i in order.items()], "field string, ordering int, value string")
        bad = ds.df.select(F.col(f"`{n}`").cast("string").alias("value")).where("value is not null").distinct().join(part, "value", "left_anti").take(1)
        if bad:
            raise LoadError(f"Invalid state {bad[0]['value']} for feature {n}")
        parts.append(part)
    if free := [n for n, order in category.items() if not order]:
        cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").cast("string").alias("value")) for n in free])
        firsts = ds.df.select(ROW, F.explode(cells).alias("c")).where("c.value is not null").groupBy("c.field", "c.value").agg(F.min(ROW).alias("__first"))
        ranked = rank_in_group(firsts, ["field"], ["__first", "value"], "__n")
        parts.append(ranked.select("field", (F.col("__n") - 1).cast("int").alias("ordering"), "value"))
    return reduce(DataFrame.unionByName, parts) if parts else None
