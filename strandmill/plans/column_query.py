"""Column queries: ``{select, from, where, limit, offset}`` against one dataset.

The predicate grammar is ``nil``, ``[and p...]``, ``[or p...]``,
``[in field values]``, ``[in any field values]`` and ``[in all field values]``.
Everything compiles to one DataFrame; filters and the needed columns reach the
scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.catalog import ROW, Catalog, Dataset, QueryError

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


#: longer lists of values become a semi-join
LONG_LIST = 2000


def word(x) -> str:
    """The text of a keyword or a string."""
    return str(getattr(x, "name", x)).lstrip(":")


def part(query: dict, key: str, default=None):
    """An entry of a query map, whose keys may be keywords or strings."""
    for k, v in query.items():
        if word(k) == key:
            return v
    return default


def is_op(x, *names: str) -> bool:
    return isinstance(x, (list, tuple)) and len(x) > 0 and not isinstance(x[0], (list, tuple, dict)) and word(x[0]) in names


def fields_of(pred) -> list[str]:
    """The fields a predicate names, each once."""
    if not pred:
        return []
    if is_op(pred, "and", "or"):
        return list(dict.fromkeys(f for p in pred[1:] for f in fields_of(p)))
    if is_op(pred, "in"):
        return [word(pred[2] if len(pred) == 4 else pred[1])]
    raise QueryError(f"not a predicate: {pred!r}")


def plain_values(values, kind: T.DataType) -> list:
    """Values of a membership test, as numbers or texts; what can't match is left out."""
    out = []
    for v in values:
        if v is None:
            continue
        if isinstance(kind, NUMBERS):
            try:
                f = float(v)
            except (TypeError, ValueError):
                continue
            if f == f:
                out.append(f)
        else:
            out.append(str(v))
    return out


def literals(values, kind: T.DataType) -> list:
    """Values of a membership test in the field's type; NULLs never match."""
    real = isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
    return [F.lit(v).cast(kind) if real else F.lit(v) for v in plain_values(values, kind)]


def member(c: Column, kind: T.DataType, values) -> Column:
    """``c`` is one of ``values``; a missing value is in no set."""
    lits = literals(values, kind)
    if not lits:
        return F.lit(False)
    return F.coalesce(c.isin(*lits), F.lit(False))


def overlaps(c: Column, intervals) -> Column:
    """A position struct overlaps one of ``[chrom start end]``; both ends are included."""
    hit = F.lit(False)
    for chrom, start, end in intervals:
        hit = hit | ((c["chrom"] == F.lit(chrom)) & (c["chromStart"] <= F.lit(int(end))) & (c["chromEnd"] >= F.lit(int(start))))
    return F.coalesce(hit, F.lit(False))


def predicate(pred, ds: Dataset, schema: T.StructType, case_sensitive_genes: bool = False) -> Column:
    """The predicate as a Column; unknown fields match nothing."""
    if not pred:
        return F.lit(True)
    if is_op(pred, "and"):
        out = F.lit(True)
        for p in pred[1:]:
            out = out & predicate(p, ds, schema, case_sensitive_genes)
        return out
    if is_op(pred, "or"):
        out = F.lit(False)
        for p in pred[1:]:
            out = out | predicate(p, ds, schema, case_sensitive_genes)
        return out
    if not is_op(pred, "in") or len(pred) not in (3, 4):
        raise QueryError(f"not a predicate: {pred!r}")
    how = word(pred[1]) if len(pred) == 4 else None
    if how not in (None, "any", "all"):
        raise QueryError(f"unknown comparison {how!r}")
    name, values = word(pred[-2]), list(pred[-1])
    f = ds.fields.get(name)
    if f is None:
        return F.lit(False)
    c = F.col(f"`{name}`")
    if f.type == "position":
        return overlaps(c, values)
    if f.type != "genes":
        return member(c, schema[name].dataType, values)
    text = [str(v) for v in values if v is not None]
    fold = (lambda x: x) if case_sensitive_genes else F.lower
    wanted = [F.lit(v if case_sensitive_genes else v.lower()) for v in text]
    among = (lambda g: fold(g).isin(*wanted)) if wanted else (lambda g: F.lit(False))
    if how == "all":  # every gene of the row is wanted; a row without genes has none that isn't
        return F.forall(F.coalesce(c, F.array().cast("array<string>")), among)
    return F.coalesce(F.exists(c, among), F.lit(False))


def split_lists(pred, ds: Dataset) -> tuple[list, object]:
    """Long lists of plain values that every row must pass, and the rest of the predicate."""
    terms = list(pred[1:]) if is_op(pred, "and") else [pred]
    long = [t for t in terms if is_op(t, "in") and len(t) == 3 and len(t[2]) > LONG_LIST and ds.fields.get(word(t[1])) and ds.fields[word(t[1])].type in ("float", "category")]
    rest = [t for t in terms if not any(t is x for x in long)]
    return long, ["and", *rest]


def column_query(catalog: Catalog, query: dict, case_sensitive_genes: bool = False, ordered: bool = True) -> DataFrame:
    """``__row`` and the selected fields of the rows that match, in row order.

    For a result that is joined or aggregated further ``ordered`` can be off,
    which saves the sort; with a limit or an offset it is always on. Selecting a field twice gives it once; a field the dataset lacks is NULL.
    An empty ``and`` matches all rows, an empty ``or`` none. Limit and offset
    count matching rows.
    """
    source = part(query, "from") or []
    if not source:
        raise QueryError("a column query needs a dataset")
    first = source[0] if isinstance(source, (list, tuple)) else source
    ds = catalog.dataset(word(first))
    select = list(dict.fromkeys(word(s) for s in part(query, "select") or []))
    where = part(query, "where")
    df = ds.columns([*select, *[f for f in fields_of(where) if f not in select]])
    long, rest = split_lists(where, ds) if where else ([], None)
    df = df.where(predicate(rest, ds, df.schema, case_sensitive_genes))
    for _, name, values in long:
        kind = df.schema[word(name)].dataType
        rows = catalog.spark.createDataFrame([(v,) for v in plain_values(values, kind)], "v double" if isinstance(kind, NUMBERS) else "v string")
        # a semi-join; the planner broadcasts the list after a check of its size
        df = df.join(rows.select(F.col("v").cast(kind).alias("__v") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("v").alias("__v")), F.col(f"`{word(name)}`") == F.col("__v"), "left_semi")
    df = df.select(ROW, *[F.col(f"`{s}`") for s in select])
    limit, offset = part(query, "limit"), part(query, "offset")
    if ordered or offset or limit is not None:
        df = df.orderBy(ROW)
    if offset:
        df = df.offset(int(offset))
    if limit is not None:
        df = df.limit(int(limit))
    return df


#: rows an answer may have; more of them are an error, for which the frame itself is to be used
ANSWER_ROWS = 2_000_000


def collected(df: DataFrame, most: int | None = None) -> list:
    """The rows of an answer; raises, before they are all fetched, if there are more than ``most``."""
    most = ANSWER_ROWS if most is None else most
    rows = df.take(most + 1)
    if len(rows) > most:
        raise QueryError(f"the answer has more than {most} rows; use a limit or the frame")
    return rows


def columnar(df: DataFrame, most: int | None = None) -> dict[str, list]:
    """A result as field -> values in row order; at most ``most`` rows (``ANSWER_ROWS``), or it raises."""
    names = [c for c in df.columns if c != ROW]
    rows = collected(df, most)
    return {n: [plain(r[n]) for r in rows] for n in names}


def plain(v):
    """Rows as maps with lower-case keys, as the outside sees positions."""
    if hasattr(v, "asDict"):
        return {k.lower(): x for k, x in v.asDict().items()}
    return v
