"""Continuous periods and gaps of overlapping intervals, by a sweep line.

Every interval turns into a ``+1`` event at its start and a ``-1`` event just
after its end. The events of one position are summed before any window sees
them, positions are cut into blocks of ``2**block_bits``, prefix sums run per
block, and the count carried into a block comes from the block totals. A window
therefore holds at most ``2**block_bits`` rows of one entity, and the windows
over an entity's blocks at most ``2**(32 - block_bits)`` rows, however many
intervals a hot entity has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BITS, STRETCH_BITS = 20, 16


def cover(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Periods and gaps per entity: ``keys``, ``kind``, ``range_start``, ``range_end``.

    Coordinates are whole numbers and both ends are included. ``kind`` is
    ``period`` for a maximal covered stretch (an interval that starts right
    after another's end continues it) and ``gap`` for the uncovered stretch
    between two consecutive periods.

    Coordinates that are no whole numbers of at most 32 bits by their type are
    cast to 64 bits first; a text that is no number counts as NULL.

    Defined cases: rows with a NULL coordinate or with ``end < start`` are no
    intervals; NULL keys form an entity of their own; repeated rows change
    nothing; an empty table gives an empty result; other columns of ``df`` are
    ignored whatever their names.
    """
    small = all(isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType)) for c in (start, end))
    number = lambda c: F.col(c).try_cast("long") if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("long")
    s, e = number(start), number(end)
    # keys travel in a struct: it is never NULL itself, so joins and windows on it
    # share one partitioning, and the summed events are shuffled once for both uses
    entity = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    events = (
        df.where(e >= s)
        .select(
            entity.alias("k"),
            F.explode(
                F.array(
                    F.struct(s.alias("pos"), F.lit(1).cast("long").alias("d")),
                    F.struct((e + 1).alias("pos"), F.lit(-1).cast("long").alias("d")),
                )
            ).alias("ev"),
        )
        .select("k", F.col("ev.pos").alias("pos"), F.col("ev.d").alias("d"))
        .groupBy("k", "pos")
        .agg(F.sum("d").alias("d"))
        .where(F.col("d") != 0)
        .select(F.struct("k", F.shiftright("pos", block_bits).alias("block")).alias("kb"), "pos", "d")
    )

    in_block = Window.partitionBy("kb").orderBy("pos")
    local = events.select("kb", "pos", "d", F.sum("d").over(in_block.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    totals = events.groupBy("kb").agg(F.sum("d").alias("d"))
    zero = F.lit(0).cast("long")
    if small:
        before = Window.partitionBy("kb.k").orderBy("kb.block").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(F.col("kb").alias("c_kb"), F.coalesce(F.sum("d").over(before), zero).alias("carry"))
    else:
        of = F.struct(F.col("kb.k").alias("k"), F.shiftright("kb.block", STRETCH_BITS).alias("stretch"))
        in_stretch = Window.partitionBy("ks").orderBy("kb.block").rowsBetween(Window.unboundedPreceding, -1)
        inner = totals.select("kb", "d", of.alias("ks")).withColumn("c", F.coalesce(F.sum("d").over(in_stretch), zero))
        over = Window.partitionBy("ks.k").orderBy("ks.stretch").rowsBetween(Window.unboundedPreceding, -1)
        outer_ = inner.groupBy("ks").agg(F.sum("d").alias("d")).select(F.col("ks").alias("o_ks"), F.coalesce(F.sum("d").over(over), zero).alias("o"))
        carry = inner.join(outer_, F.col("ks") == F.col("o_ks")).select(F.col("kb").alias("c_kb"), (F.col("c") + F.col("o")).alias("carry"))
    active = local.join(carry, F.col("kb") == F.col("c_kb")).select("kb", "pos", (F.col("carry") + F.col("n")).alias("after"), "d")
    edges = active.where((F.col("after") == 0) | (F.col("after") == F.col("d"))).select("kb", "pos", (F.col("after") > 0).alias("opens"))

    # the next edge: within the block, or the first edge of the next block that has one
    nexts = edges.select(
        "kb", "pos", "opens", F.lead("pos").over(in_block).alias("n"), (F.row_number().over(in_block) == 1).alias("first")
    )
    levels = [None] if small else [F.shiftright("kb.block", STRETCH_BITS), None]
    for stretch in levels:
        # the rims of the blocks (then of the stretches) meet in one window; all other rows stay where they are
        rim = F.col("n").isNull() | F.col("first")
        group = F.when(rim, F.lit(-(1 << 40)).cast("long") if stretch is None else stretch).otherwise(F.col("kb.block"))
        at_rim = Window.partitionBy("kb.k", rim, group).orderBy("pos")
        nexts = nexts.select("kb", "pos", "opens", F.coalesce("n", F.lead("pos").over(at_rim)).alias("n"), (rim & (F.row_number().over(at_rim) == 1)).alias("first"))
    return nexts.where(F.col("n").isNotNull()).select(
        *[F.col(f"kb.k.k{i}").alias(k) for i, k in enumerate(keys)],
        F.when(F.col("opens"), "period").otherwise("gap").alias("kind"),
        F.col("pos").alias("range_start"),
        (F.col("n") - 1).alias("range_end"),
    )
