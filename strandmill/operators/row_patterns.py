"""Tab-separated lines into typed rows and rejected lines with reasons.

Per file, the header gives a schema; per schema, one anchored regular
expression is generated that a whole good row must match. Only lines that fail
it meet the incremental patterns: prefixes of one, two, three ... fields, of
which the first that fails names the broken field. A line that matches a prefix
matches all shorter ones, so the first that fails is found by halving, with as
many patterns as the number of fields has binary digits. There are three series,
for the number of cells, their quoting and their values; the first series with
a failure gives the reason. All patterns use possessive quantifiers, so a cell
is read once, without recursion, however long it is; rows of more than ``WIDTH``
fields are matched in stretches of so many.

Patterns travel as columns beside the lines, so no schema is ever collected;
lines of one file lie together after the join with their header, and the JVM
keeps the last compiled pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.scalars import normalize_chrom, split_genes

#: blanks that don't count around a cell
PAD = r"[ \r]*+"
ANY = r'(?:[^"\t]*+|' + PAD + r'"(?:[^"\t]++|"")*+"' + PAD + ")"
FILLED = "(?:" + PAD + r'[^"\t \r][^"\t]*+|' + PAD + r'"(?:[^"\t]++|"")++"' + PAD + ")"
NUMBER = r"(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"
CELL = r"[^\t]*+"
COORD = "(?:" + PAD + NUMBER + PAD + "|" + PAD + '"' + NUMBER + '"' + PAD + ")"
MAX_COORD = 2147483647
#: fields that one pattern matches at most; the engine of patterns goes deeper with every field
WIDTH_BITS = 7
WIDTH = 1 << WIDTH_BITS


@dataclass(frozen=True)
class RowSchema:
    """Roles of columns: ``role -> aliases`` (lower case) and what each cell must be."""

    aliases: dict[str, tuple[str, ...]]
    filled: tuple[str, ...] = ()
    coordinates: tuple[str, ...] = ()
    ordered: tuple[str, str] | None = None


#: fixed values: header names of probe annotation files
PROBE_MAP = RowSchema(
    aliases={
        "name": ("name", "id"),
        "chrom": ("chrom", "chr"),
        "chromstart": ("start", "chromstart"),
        "chromend": ("end", "chromend"),
        "genes": ("gene", "genes"),
        "strand": ("strand",),
    },
    filled=("name",),
    coordinates=("chromstart", "chromend"),
    ordered=("chromstart", "chromend"),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever number of times the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bare(cell: Column) -> Column:
    """A cell without the blanks around it and without its quotes."""
    t = F.trim(cell, F.lit(" \r"))
    quoted = lambda x: (F.length(x) >= 2) & x.startswith('"') & x.endswith('"')
    inner = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return let(t, lambda x: F.when(quoted(x), inner(x)).otherwise(x))


def whole_number(text: Column) -> Column:
    """Exact value of a decimal text if it is a whole number up to ``MAX_COORD``; else NULL.

    Works on the digits, not on a binary float: ``1e3``, ``012``, ``5.0`` and
    ``1500e-2`` have values, ``1.5`` and anything with a sign has none.
    """
    huge = F.lit(10**12).cast("long")

    def parts(low: Column) -> Column:
        mant, expo = F.substring_index(low, "e", 1), F.regexp_extract(low, "e([+-]?[0-9]+)$", 1)
        frac = F.when(F.contains(mant, F.lit(".")), F.substring_index(mant, ".", -1)).otherwise("")
        digits = F.regexp_replace(F.concat(F.substring_index(mant, ".", 1), frac), "^0+", "")
        power = F.coalesce(F.when(expo == "", F.lit(0).cast("long")).otherwise(expo.try_cast("long")), F.when(F.startswith(expo, F.lit("-")), -huge).otherwise(huge))
        return F.struct(digits.alias("d"), (F.length(digits) + power - F.length(frac)).alias("size"))

    def value(p: Column) -> Column:
        core, size = F.regexp_replace(p["d"], "0+$", ""), p["size"]  # size: digits before the point
        fits = (size >= F.length(core)) & (size <= 10)
        number = F.rpad(core, F.greatest(F.least(size, F.lit(10)), F.lit(0)).cast("int"), "0").try_cast("long")
        return F.when(p["d"] == "", F.lit(0).cast("long")).when(fits, number)

    def read(t: Column) -> Column:
        odd = F.when(t.rlike("^" + NUMBER + "$"), let(parts(F.lower(t)), value))
        return F.when(t.rlike("^[0-9]{1,10}$"), t.try_cast("long")).otherwise(odd)

    return let(let(text, read), lambda v: F.when(v <= MAX_COORD, v))


def stretches(roles: Column) -> Column:
    """The numbers, from 0, of the stretches of ``WIDTH`` fields that a row is matched in."""
    return F.sequence(F.lit(0), F.shiftright(F.size(roles) - 1, WIDTH_BITS))


def stretch(line: Column, roles: Column, j: Column) -> Column:
    """The text of one stretch of a line; the last one has all that is left; NULL if the line ends before it."""
    cells = let(F.split(line, "\t", -1), lambda x: F.slice(x, j * WIDTH + 1, F.when((j + 1) * WIDTH < F.size(roles), F.lit(WIDTH)).otherwise(F.size(x) + 1)))
    return F.when(F.size(roles) <= WIDTH, line).otherwise(let(cells, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\t"))))


def pattern(roles: Column, cell, j: Column) -> Column:
    """The anchored pattern of a stretch."""
    return F.concat(F.lit(r"\A"), F.array_join(F.transform(F.slice(roles, j * WIDTH + 1, F.lit(WIDTH)), cell), r"\t"), F.lit(r"\z"))


def first_broken(line: Column, roles: Column, cell) -> Column:
    """The place, from 1, of the first field at which the patterns of field prefixes stop to match; NULL if all match.

    ``cell(role)`` is the pattern of a field. The prefix of k fields must end at
    a tab or with the line, that of all fields with the line. In a row of
    several stretches the first one that fails is searched.
    """

    def within(text: Column, own: Column) -> Column:
        n = F.size(own)

        def prefix(k: Column) -> Column:
            return F.concat(F.lit(r"\A"), F.array_join(F.transform(F.slice(own, F.lit(1), k), cell), r"\t"), F.when(k == n, r"\z").otherwise(r"(?=\t|\z)"))

        def halve(span: Column, _: Column) -> Column:
            mid = F.shiftright(span["lo"] + span["hi"], 1)
            upper, lower = F.struct((mid + 1).alias("lo"), span["hi"].alias("hi")), F.struct(span["lo"].alias("lo"), mid.alias("hi"))
            return F.when(span["lo"] >= span["hi"], span).when(F.rlike(text, prefix(mid)), upper).otherwise(lower)

        steps = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1))).cast("int"))
        start = F.struct(F.lit(1).alias("lo"), (n + 1).alias("hi"))
        return F.aggregate(steps, start, halve, lambda span: F.when(span["lo"] <= n, span["lo"]))

    failed = F.get(F.filter(stretches(roles), lambda j: ~F.coalesce(F.rlike(stretch(line, roles, j), pattern(roles, cell, j)), F.lit(False))), F.lit(0))
    at = F.when(F.size(roles) <= WIDTH, F.lit(0)).otherwise(failed)
    own = lambda j: F.slice(roles, j * WIDTH + 1, F.lit(WIDTH))
    return let(at, lambda j: F.when(j.isNotNull(), j * WIDTH + let(stretch(line, roles, j), lambda t: within(t, own(j)))))


def headers(lines: DataFrame, schema: RowSchema, file: str, order: str, line: str) -> DataFrame:
    """One row per file: ``__f``, ``__hn`` (place of the header), ``__names``, ``__roles``, ``__pattern``."""
    # first the places, by hash aggregation of numbers; then the few lines there
    some = lines.where((F.regexp_replace(line, r"\s+", "") != "") & F.col(order).isNotNull())
    places = some.groupBy(F.col(file).alias("__pf")).agg(F.min(order).alias("__pn"))
    at_place = F.col(file).eqNullSafe(F.col("__pf")) & (F.col(order) == F.col("__pn"))
    found = some.join(places, at_place).groupBy(F.col(file).alias("__f"), F.col(order).alias("__hn")).agg(F.min(line).alias("__h"))
    names = F.transform(F.split(F.regexp_replace("__h", r"^\s*#", ""), "\t", -1), bare)
    role = lambda x: F.coalesce(
        *[F.when(F.lower(x).isin(*names_), F.lit(r)) for r, names_ in schema.aliases.items()], F.lit("")
    )
    first = found.select("__f", "__hn", names.alias("__names")).withColumn(
        "__roles", F.transform("__names", role)
    )
    # a role belongs to the first column that claims it
    first = first.withColumn(
        "__roles",
        F.transform("__roles", lambda r, i: F.when(F.array_position(F.col("__roles"), r) == i + 1, r).otherwise("")),
    )
    # a row of several stretches has no single pattern
    single = F.when(F.size("__roles") <= WIDTH, pattern(F.col("__roles"), strict(schema), F.lit(0)))
    return first.withColumn("__pattern", single)


def strict(schema: RowSchema):
    """role -> the pattern of a good cell."""
    return lambda r: F.when(r.isin(*schema.filled), F.lit(FILLED)).when(r.isin(*schema.coordinates), F.lit(COORD)).otherwise(F.lit(ANY))


def parse_rows(
    lines: DataFrame, schema: RowSchema = PROBE_MAP, file: str = "source_id", order: str = "line_no", line: str = "line"
) -> DataFrame:
    """Every record of every file, with its values or with the reason it is rejected.

    Columns: ``file``, ``order``, ``line`` as named, one column per role of the
    schema (typed; NULL where the file lacks it or the record is rejected),
    ``reason`` (NULL for good rows; else ``column_count``, ``quoting`` or
    ``invalid_value``, the first that applies), ``broken_at`` (place of the
    first broken field, from 1) and ``broken_name`` (its header).

    Defined cases: blank lines and lines that start with ``#`` after the header
    are no records; a NULL line is blank; a line without a number is never a
    header; NULL files form a file of their own; a file of blank lines yields
    nothing; repeated lines give repeated rows (see :func:`distinct_records`);
    columns of ``lines`` beyond the three are dropped, so none can clash.
    """
    only = lines.select(F.col(file).alias("__file"), F.col(order).alias("__n"), F.col(line).alias("__line"))
    head = headers(only, schema, "__file", "__n", "__line")
    records = only.where(
        F.col("__line").isNotNull() & ~F.startswith("__line", F.lit("#")) & (F.regexp_replace("__line", r"\s+", "") != "")
    )
    joined = records.join(head, F.col("__file").eqNullSafe(F.col("__f"))).where(
        F.col("__n").isNull() | (F.col("__n") > F.col("__hn"))
    )
    line_, roles, cells = F.col("__line"), F.col("__roles"), F.split("__line", "\t", -1)
    wide = (F.size(cells) == F.size(roles)) & F.forall(stretches(roles), lambda j: F.rlike(stretch(line_, roles, j), pattern(roles, strict(schema), j)))
    whole = F.call_function("regexp_extract", line_, F.col("__pattern"), F.lit(0)) != ""
    matched = joined.withColumn("__ok", F.when(F.col("__pattern").isNotNull(), whole).otherwise(wide))
    at = lambda r: F.array_position("__roles", F.lit(r)).cast("int")
    value = lambda r: F.when(F.col("__ok") & (at(r) > 0), bare(F.get(cells, at(r) - 1)))
    typed = matched.select(
        "*", *[(whole_number(value(r)) if r in schema.coordinates else value(r)).alias(f"v_{r}") for r in schema.aliases]
    )

    # rows that pass the pattern but not the exact value check
    wrong = F.lit(None).cast("int")
    if schema.ordered:
        a, b = (F.col(f"v_{r}") for r in schema.ordered)
        wrong = F.when(a > b, at(schema.ordered[0]))
    for r in reversed(schema.coordinates):
        wrong = F.when((at(r) > 0) & F.col(f"v_{r}").isNull(), at(r)).otherwise(wrong)
    # rows that fail it: the first series of prefixes that does not match to its end
    def at_series(cell, what: str, rest: Column) -> Column:
        return let(first_broken(line_, roles, cell), lambda k: F.when(k.isNotNull(), F.struct(F.lit(what).alias("reason"), k.alias("at"))).otherwise(rest))

    none = F.lit(None).cast("struct<reason: string, at: int>")
    series = at_series(lambda r: F.lit(CELL), "column_count", at_series(lambda r: F.lit(ANY), "quoting", at_series(strict(schema), "invalid_value", none)))
    late = F.when(wrong.isNotNull(), F.struct(F.lit("invalid_value").alias("reason"), wrong.alias("at")))
    judged = typed.withColumn("__broken", F.when(F.col("__ok"), late).otherwise(series))
    done = judged.select("*", F.col("__broken.reason").alias("__reason"), F.col("__broken.at").alias("__at"))
    good = F.col("__reason").isNull()
    out = []
    for r in schema.aliases:
        v = F.col(f"v_{r}")
        v = v.cast("int") if r in schema.coordinates else v
        v = normalize_chrom(v) if r == "chrom" else split_genes(v) if r == "genes" else v
        out.append(F.when(good, v).alias(r))
    return done.select(
        F.col("__file").alias(file),
        F.col("__n").alias(order),
        F.col("__line").alias(line),
        *out,
        F.col("__reason").alias("reason"),
        F.col("__at").alias("broken_at"),
        F.get("__names", F.col("__at") - 1).alias("broken_name"),
    )


def distinct_records(parsed: DataFrame, file: str = "source_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """Each distinct line of a file once."""
    return parsed.dropDuplicates([file, order, line])
