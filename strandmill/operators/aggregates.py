"""Aggregates of the engine that need more than one built-in function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.catalog import ROW, with_rows
from strandmill.functions.scalars import nan_to_null, null_to_nan


def nan_mean(c: Column) -> Column:
    """Mean without missing values; NaN where all are missing."""
    return null_to_nan(F.avg(nan_to_null(c.cast("double"))))


def group_concat(df: DataFrame, keys: list[str], value: str, order: str, name: str, separator: str = "\t") -> DataFrame:
    """Texts of a group joined in the order of a column."""
    sep = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t")
    return df.groupBy(*keys).agg(F.expr(f"listagg(`{value}`, '{sep}') WITHIN GROUP (ORDER BY `{order}`)").alias(name))


def first_codes(df: DataFrame, value: str, order: str) -> DataFrame:
    """``value``, ``code``: distinct values numbered from 0 by first occurrence.

    The distinct values are numbered over ranges, so a dictionary of any size
    is never in one task. NULL has no code.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("__first"))
    return with_rows(first, "__first", value).select(value, F.col(ROW).alias("code"))


def rows_of_groups(df: DataFrame, key: str, order: str, value: str, name: str = "rows") -> DataFrame:
    """Rows of each group in order, as an array."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))


def rank_in_group(df: DataFrame, keys: list[str], order: list[str], out: str = "n") -> DataFrame:
    """Place of each row within its group, from 1, in the given order.

    Rows are numbered over the whole frame in the order of the groups, which
    splits a large group over many partitions; the least number of a group,
    one row a group, is then taken off. No task holds a group. NULL keys form
    a group of their own; ``order`` should be unique within a group.
    """
    placed = with_rows(df, *keys, *order)
    least = placed.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(F.min(ROW).alias("__least"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    joined = placed.join(least, same).withColumn(out, F.col(ROW) - F.col("__least") + 1)
    return joined.drop(ROW, "__least", *[f"__g{i}" for i in range(len(keys))])


def suffixed(name: Column, n: Column) -> Column:
    """A name, with `` (n)`` from its second copy on."""
    return F.when(n == 1, name).otherwise(F.concat(name, F.lit(" ("), n.cast("string"), F.lit(")")))


def numbered_copies(df: DataFrame, name: str, order: str, out: str = "field") -> DataFrame:
    """Repeated names get `` (2)``, `` (3)`` ... in order."""
    ranked = rank_in_group(df, [name], [order], "__n")
    return ranked.withColumn(out, suffixed(F.col(name), F.col("__n"))).drop("__n")
