"""Scalar column functions of the load path and of interval arithmetic.

Everything here stays inside the JVM; none of it raises on dirty input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the interval binning scheme: offset of each level, finest first,
# and the shifts between levels.
BIN_OFFSETS = [4681, 585, 73, 9, 0]
BIN_FIRST_SHIFT = 17
BIN_NEXT_SHIFT = 3

# Fixed cell texts that mean "no number".
MISSING_NUMBERS = ["NA", "nan", ""]


def trim_all(c: Column) -> Column:
    """Strip white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_chrom(c: Column) -> Column:
    """``1``, ``CHR1`` -> ``chr1``; ``x``/``y``/``m`` likewise; other names only trimmed."""
    t = trim_all(c)
    low = F.lower(t)
    bare = F.regexp_replace(low, "^chr", "")
    return (
        F.when(bare.rlike("^[0-9]+$"), F.concat(F.lit("chr"), bare))
        .when(bare.isin("x", "y", "m"), F.concat(F.lit("chr"), F.upper(bare)))
        .otherwise(t)
    )


def parse_float_na(c: Column) -> Column:
    """Text to float; ``NA``, ``nan``, blank and unparsable texts become NULL."""
    t = F.trim(c)
    return F.when(t.isin(*MISSING_NUMBERS), F.lit(None)).otherwise(t).try_cast("float")


def parse_coordinate(c: Column, shift: int = 0) -> Column:
    """Coordinate text (``1e7`` and ``012e6`` are accepted) to int, plus ``shift``."""
    return (F.trim(c).try_cast("double").try_cast("long") + F.lit(shift).cast("long")).try_cast("int")


def split_genes(c: Column) -> Column:
    """``"a, b,,c"`` -> ``[a, b, c]``; NULL when nothing is left."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def shift_int_csv(c: Column, shift: int = 0) -> Column:
    """Comma list of integers: blanks dropped, ``shift`` added, joined again."""
    parts = F.filter(F.split(c, ","), lambda x: F.trim(x) != "")
    return F.array_join(F.transform(parts, lambda x: (F.trim(x).try_cast("long") + F.lit(shift)).cast("string")), ",")


def calc_bin(start: Column, end: Column) -> Column:
    """Bin of the finest level at which ``start >> s`` equals ``(end - 1) >> s``; NULL if none."""
    out = None
    last = end - F.lit(1)
    for level, offset in enumerate(BIN_OFFSETS):
        s = BIN_FIRST_SHIFT + BIN_NEXT_SHIFT * level
        a, b = F.shiftright(start, s), F.shiftright(last, s)
        hit = a + F.lit(offset)
        out = F.when(a == b, hit) if out is None else out.when(a == b, hit)
    return out


def overlapping_bins(start: Column, end: Column) -> Column:
    """Array of ``{lo, hi}`` bin ranges, one per level, finest first."""
    last = end - F.lit(1)
    rows = []
    for level, offset in enumerate(BIN_OFFSETS):
        s = BIN_FIRST_SHIFT + BIN_NEXT_SHIFT * level
        lo = F.shiftright(start, s) + F.lit(offset)
        hi = F.shiftright(last, s) + F.lit(offset)
        rows.append(F.struct(lo.alias("lo"), hi.alias("hi")))
    return F.array(*rows)


def nan_to_null(c: Column) -> Column:
    """Missing values are NULL inside the engine."""
    return F.when(~F.isnan(c), c)


def null_to_nan(c: Column) -> Column:
    """Missing values are NaN at the edges of the engine."""
    return F.coalesce(c, F.lit(float("nan")))


def array_mean(a: Column) -> Column:
    """Mean of an array without its NULL and NaN entries; NaN when none is left."""
    ok = F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(ok, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double"))
    return F.when(F.size(ok) > 0, total / F.size(ok)).otherwise(F.lit(float("nan")))


def array_scale(a: Column, factor: float, shift: float = 0.0) -> Column:
    """Every number of an array times ``factor``, plus ``shift``."""
    return F.transform(a, lambda x: x.cast("double") * F.lit(factor) + F.lit(shift))


def array_minus(a: Column, b: Column) -> Column:
    """Differences place by place; what one array lacks is NULL."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def sorted_union(a: Column, b: Column) -> Column:
    """The distinct entries of two arrays, in order."""
    return F.array_sort(F.array_union(a, b))


def sorted_except(a: Column, b: Column) -> Column:
    """The distinct entries of one array that another lacks, in order."""
    return F.array_sort(F.array_except(a, b))
