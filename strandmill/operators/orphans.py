"""References to records that do not exist, with a cascade down the foreign keys.

A *direct* orphan refers to a key that no live record has. A record that refers
to a direct or inherited orphan is an *inherited* orphan; the cascade follows
the foreign-key graph by semi-joins until a round adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.session import own_dir, written

#: an edge: the foreign key it belongs to (its place in the list), the referring record and what it refers to
EDGE = ["fk", "table_name", "row_id", "ref", "shown", "key", "period"]


@dataclass(frozen=True)
class Reference:
    """A foreign key: rows of ``child`` refer by ``ref`` to ``key`` of ``parent``.

    ``child`` needs the columns ``row_id``, ``ref``, ``key`` (what others may
    refer to it by; may be NULL) and ``time``; ``parent`` the columns ``key``,
    ``live`` (boolean) and ``time``. ``timed`` says whether a target that came
    later than the reference counts as ``late``. Keys are compared as text.
    """

    table: str
    child: DataFrame
    parent_table: str
    parent: DataFrame
    timed: bool = False
    by: str = "key"  # the column of an orphaned parent row that its children refer to: key or row_id


def edges(references: list[Reference]) -> DataFrame:
    """All references of all foreign keys: the columns of ``EDGE`` and ``time``; each once, without the NULL ones."""
    parts = []
    for i, r in enumerate(references):
        shown = F.col("ref_shown") if "ref_shown" in r.child.columns else F.col("ref")
        parts.append(
            r.child.where(F.col("ref").isNotNull()).select(
                F.lit(i).alias("fk"), F.lit(r.table).alias("table_name"), F.col("row_id").cast("long").alias("row_id"), F.col("ref").cast("string").alias("ref"),
                shown.cast("string").alias("shown"), F.col("key").cast("string").alias("key"), F.date_format("time", "yyyy-MM").alias("period"), F.col("time").cast("timestamp").alias("time"),
            )
        )
    return reduce(DataFrame.unionByName, parts).distinct()


def targets(references: list[Reference]) -> DataFrame:
    """One row per foreign key and key of its parent: ``fk``, ``ref``, ``any_live``, ``live_time`` (NULL unless it is timed)."""
    parts = []
    for i, r in enumerate(references):
        time = F.min(F.when(F.col("live"), F.col("time").cast("timestamp"))) if r.timed else F.lit(None).cast("timestamp")
        folded = r.parent.where(F.col("key").isNotNull()).groupBy(F.col("key").cast("string").alias("ref")).agg(F.max("live").alias("any_live"), time.alias("live_time"))
        parts.append(folded.select(F.lit(i).alias("fk"), "ref", "any_live", "live_time"))
    return reduce(DataFrame.unionByName, parts)


def judged(edge_rows: DataFrame, references: list[Reference]) -> DataFrame:
    """The edges that hang: ``EDGE`` and ``kind``.

    Targets have one row per key, so a popular key meets one row; the side of
    the references keeps its partitions and is split by the adaptive skew join.
    """
    kind: Column = (
        F.when(F.col("any_live").isNull(), "missing").when(~F.col("any_live"), "deleted").when(F.col("live_time") > F.col("time"), "late")
    )
    found = edge_rows.join(targets(references), ["fk", "ref"], "left").withColumn("kind", kind)
    return found.where(F.col("kind").isNotNull()).select(*EDGE, "kind")


def direct_orphans(ref: Reference) -> DataFrame:
    """Direct orphans of one foreign key: ``table_name``, ``row_id``, ``ref``, ``key``, ``period``, ``kind``.

    ``kind``: ``missing`` if no record has the key, ``deleted`` if none that has
    it is live, ``late`` if the earliest live one is later than the reference.
    ``ref_shown`` of the child, where it exists, is reported in place of the
    key that is compared.

    Defined cases: NULL references are none; NULL times are never late and give
    a NULL period; repeated rows are reported once.
    """
    return judged(edges([ref]), [ref]).select("table_name", "row_id", F.col("shown").alias("ref"), "key", "period", "kind").distinct()


def cascade(references: list[Reference]) -> DataFrame:
    """All orphans: the columns of :func:`direct_orphans`, and ``depth`` (0: direct).

    Inherited orphans have kind ``inherited``; the depth is the number of steps
    to the nearest direct one. A record that is a direct orphan by one
    reference stays direct. The target of a ``late`` reference exists, so the
    record is reported but not lost: nothing is inherited from it, and it can
    still inherit from its target.

    The references are written once. Every round joins only what the last round
    added with them, writes what is new beside the earlier rounds, and the
    first round that adds nothing ends it: there are as many rounds as the
    longest chain has steps, cycles end because a reference is added once.
    """
    spark = references[0].child.sparkSession
    all_edges = written(edges(references), "edges")
    at = own_dir(spark, "orphans")
    judged(all_edges, references).write.parquet(f"{at}/depth=0")
    kinds = ", ".join(f"{c} {'int' if c == 'fk' else 'long' if c == 'row_id' else 'string'}" for c in [*EDGE, "kind"])
    # what the children of a table's rows refer to: by which foreign keys, and in which column
    heirs: dict[str, list[Column]] = {}
    for i, r in enumerate(references):
        heirs.setdefault(r.parent_table, []).append(F.struct(F.lit(i).alias("fk"), F.col(r.by).cast("string").alias("ref")))
    lost = None
    for parent, keys in heirs.items():
        lost = (F if lost is None else lost).when(F.col("table_name") == parent, F.array(*keys))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in EDGE])
    depth = 0
    while True:
        fresh = spark.read.schema(kinds).parquet(f"{at}/depth={depth}")
        if fresh.isEmpty():
            break
        keys = fresh.where("kind <> 'late'").select(F.explode(lost).alias("x")).select("x.*").where("ref is not null")
        hit = all_edges.select(*EDGE).join(keys, ["fk", "ref"], "left_semi")
        known = spark.read.schema(f"{kinds}, depth int").parquet(at).where("kind <> 'late'").select(*EDGE)
        depth += 1
        hit.join(known, same(hit, known), "left_anti").withColumn("kind", F.lit("inherited")).select(*EDGE, "kind").write.parquet(f"{at}/depth={depth}")
    found = spark.read.schema(f"{kinds}, depth int").parquet(at)
    return found.select("table_name", "row_id", F.col("shown").alias("ref"), "key", "period", "kind", "depth").distinct()
