"""Joins of intervals that overlap, by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.scalars import BIN_FIRST_SHIFT, BIN_NEXT_SHIFT, BIN_OFFSETS

# Shifts of the levels, finest first: those of the binning scheme, then wider steps for coordinates of 64 bits.
SHIFTS = [BIN_FIRST_SHIFT + BIN_NEXT_SHIFT * v for v in range(len(BIN_OFFSETS))] + [37, 45, 53]
LEVELS = len(SHIFTS)


def _bin(pos: Column, level: int) -> Column:
    """The bin of a position; beyond the last level there is one bin for all."""
    return F.shiftright(pos, SHIFTS[level]) if level < LEVELS else F.lit(0).cast("long")


def _slot(level: int, bin_: Column) -> Column:
    """Bin and level in one number, the level in the last four bits; a bin has 47 bits at most."""
    return F.shiftleft(bin_, 4).bitwiseOR(F.lit(level).cast("long"))


def _home(start: Column, end: Column) -> Column:
    """The finest bin that holds an interval whole."""
    out = None
    for level in range(LEVELS):
        fits = _bin(start, level) == _bin(end, level)
        slot = _slot(level, _bin(start, level))
        out = F.when(fits, slot) if out is None else out.when(fits, slot)
    return out.otherwise(_slot(LEVELS, _bin(start, LEVELS)))


def overlap_join(
    left: DataFrame, right: DataFrame, on: tuple[str, str], left_range: tuple[str, str], right_range: tuple[str, str], how: str = "inner"
) -> DataFrame:
    """Pairs of rows with the same key whose closed intervals overlap.

    Each left row sits in the one bin that holds it whole; each right row
    visits, at every level, the bins its interval touches. A pair therefore
    meets exactly once, in the bin of the left row, and needs no
    de-duplication; the residual condition is the exact overlap. The left side,
    which should be the larger one, is shuffled as it is; a right interval of
    length n visits about ``n >> 17`` bins of the finest level. Coordinates are
    of up to 64 bits. Neither side is broadcast. ``how``: ``inner``, or
    ``left_semi`` for the left rows that overlap anything.

    Defined cases: NULL keys or coordinates and reversed intervals overlap
    nothing; repeated rows give repeated pairs; columns of one name on both
    sides stay apart by their frames.
    """
    (ls, le), (rs, re_) = left_range, right_range
    a = left.where((F.col(le) >= F.col(ls)) & F.col(on[0]).isNotNull())
    b = right.where((F.col(re_) >= F.col(rs)) & F.col(on[1]).isNotNull())
    # one expression for level and bin keeps the plan small: the optimizer copies key expressions into its filters
    placed = a.withColumn("__home", _home(F.col(ls).cast("long"), F.col(le).cast("long")))

    start, end = F.col(rs).cast("long"), F.col(re_).cast("long")

    def touched(level: int) -> Column:
        return F.transform(F.sequence(_bin(start, level), _bin(end, level)), lambda x: _slot(level, x))

    visiting = b.withColumn("__visit", F.explode(F.concat(*[touched(v) for v in range(LEVELS + 1)])))
    cond = (
        (F.col("__home") == F.col("__visit"))  # first, since a sort by a number is cheaper than one by a name
        & (placed[on[0]] == visiting[on[1]])
        & (placed[ls] <= visiting[re_])
        & (placed[le] >= visiting[rs])
    )
    # the planner takes the exploded side for as small as its files and would broadcast it
    return placed.join(visiting.hint("merge"), cond, how).drop("__home", "__visit")
