import re

import pytest
from pyspark.sql import functions as F

from strandmill.operators import row_patterns as R

SCHEMA = "source_id int, line_no int, line string"
HEAD = "#id\tgenes\tchrom\tstart\tend\tstrand"


def parse(spark, data, schema=SCHEMA):
    return R.parse_rows(spark.createDataFrame(data, schema))


def reasons(spark, *lines):
    df = parse(spark, [(1, 1, HEAD)] + [(1, i + 2, x) for i, x in enumerate(lines)])
    got = {r["line_no"] - 2: r for r in df.collect()}
    return [got[i]["reason"] if i in got else "skipped" for i in range(len(lines))]


def test_reasons_in_their_order(spark):
    ok = 'P1\tA,B\t1\t10\t20\t+'
    assert reasons(spark, ok, ok + "\tx", "P1\tA", 'P"1\tA\t1\tx\t20\t+', '"P1\tA\t1\t10\t20\t+', "\tA\t1\t10\t20\t+") == [
        None, "column_count", "column_count", "quoting", "quoting", "invalid_value",
    ]
    assert reasons(spark, "", "  \t ", "# note", ' "P""1" \t"a\tb"\t1\t10\t20\t+', '"a""b"\t""\t1\t"10"\t" 20"\t+\r') == [
        "skipped", "skipped", "skipped", "column_count", "invalid_value",
    ]


@pytest.mark.parametrize(
    "text,value",
    [
        ("0", 0), ("007", 7), ("1e3", 1000), ("5.0", 5), ("5.", 5), ("1500e-2", 15), ("1.5e1", 15), ("2147483647", 2147483647), ("2.147483647e9", 2147483647),
        (".5e1", 5), ("0e999999999999", 0), ("0.00", 0), ("00000000000000000000012", 12), ("1E+2", 100), ("120e-1", 12),
        ("2147483648", None), ("1.5", None), ("1e10", None), ("-1", None), ("+1", None), ("1,000", None), ("0x10", None), ("1 0", None), ("NA", None), ("", None),
        (".", None), ("e5", None), ("1e", None), ("12e-1", None), ("1e99999999999999999999", None), ("1e-99999999999999999999", None), ("١", None), ("Infinity", None),
    ],
)
def test_whole_numbers(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(R.whole_number(F.col("t")).alias("v")).first()["v"]
    assert got == value


def test_broken_field_is_named(spark):
    df = parse(spark, [(1, 1, HEAD), (1, 2, 'P1\tA\t1\tten\t20\t+'), (1, 3, 'P1\tA\t"1\t10\t20\t+'), (1, 4, "P1\tA\t1\t30\t20\t+"), (1, 5, "P1\tA")])
    got = {r["line_no"]: (r["reason"], r["broken_at"], r["broken_name"]) for r in df.collect()}
    assert got == {2: ("invalid_value", 4, "start"), 3: ("quoting", 3, "chrom"), 4: ("invalid_value", 4, "start"), 5: ("column_count", 3, "chrom")}


def test_typed_rows_and_headers_per_file(spark):
    data = [
        (1, 1, HEAD), (1, 2, ' "P""1" \tA, B,\tx\t1e2\t"0200"\t+\r'),
        (2, 3, "   "), (2, 4, "Chr\tEND\tChromStart\tName"), (2, 5, "12\t9\t8\tQ"), (2, 5, "12\t9\t8\tQ"),
        (3, 1, None), (3, 2, ""),
    ]
    got = sorted(R.distinct_records(parse(spark, data)).collect(), key=lambda r: r["source_id"])
    cols = ("source_id", "line_no", "name", "chrom", "chromstart", "chromend", "genes", "strand", "reason")
    assert [tuple(r[c] for c in cols) for r in got] == [
        (1, 2, 'P"1', "chrX", 100, 200, ["A", "B"], "+", None), (2, 5, "Q", "chr12", 8, 9, None, None, None),
    ]


def test_nulls_empty_tables_and_clashing_columns(spark):
    assert parse(spark, []).count() == 0
    df = parse(spark, [(None, 1, HEAD), (None, 2, "P\tA\t1\t1\t2\t+"), (None, None, "P\tA\t1\t1\t2"), (1, 1, HEAD)])
    assert sorted((r["line_no"] or 0, r["reason"]) for r in df.collect()) == [(0, "column_count"), (2, None)]
    extra = parse(spark, [(1, 1, HEAD, "x", "y"), (1, 2, "P\tA\t1\t1\t2\t+", "x", "y")], SCHEMA + ", name string, reason string")
    assert [(r["name"], r["reason"]) for r in extra.collect()] == [("P", None)]


def test_very_long_cells(spark):
    long = "A" * 300_000
    quotes = '"' + '""' * 50_000 + '"'
    open_quotes = '"' + '""' * 50_000
    blanks = " " * 200_000
    assert reasons(
        spark, f"{long}\tA\t1\t1\t2\t+", f"{quotes}\tA\t1\t1\t2\t+", f"{open_quotes}\tA\t1\t1\t2\t+", f"P{blanks}\tA\t1\t{blanks}1\t2\t+", f'{blanks}"\tA\t1\t1\t2\t+'
    ) == [None, None, "quoting", None, "quoting"]


def plain_judge(line, header):
    """The rules of the task, cell by cell."""
    strip = lambda c: c.strip(" \r")
    cells = [strip(c) for c in line.split("\t")]
    names = [strip(h).lower() for h in header.lstrip("#").split("\t")]
    if len(cells) != len(names):
        return "column_count"
    vals = []
    for c in cells:
        if '"' in c:
            if len(c) < 2 or c[0] != '"' or c[-1] != '"' or '"' in c[1:-1].replace('""', ""):
                return "quoting"
            c = c[1:-1].replace('""', '"')
        vals.append(c)

    def number(t):
        from decimal import Decimal

        if not re.fullmatch(r"([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t, re.A):
            return None
        d = Decimal(t)
        return int(d) if d == d.to_integral_value() and d <= 2147483647 else None

    row = dict(zip(names, vals))
    a, b = number(row["start"]), number(row["end"])
    return "invalid_value" if not row["id"] or a is None or b is None or a > b else None


def test_against_plain_rules(spark):
    import random

    rnd = random.Random(5)
    pool = ["P1", '"P1"', '"P""1"', 'P"1', '"', '""', "", " ", "5", "5.0", "1e1", "12", "2147483648", "x", '"7"', "7 ", '" 7"', "-1", "#", "A\r"]
    lines = ["\t".join(rnd.choice(pool) for _ in range(rnd.choice([6, 6, 6, 6, 5, 7]))) for _ in range(1500)]
    lines = [x for x in dict.fromkeys(lines) if x.strip() and not x.startswith("#")]
    assert reasons(spark, *lines) == [plain_judge(x, HEAD) for x in lines]


@pytest.mark.parametrize("width", [1, 2, 7, 128, 129, 500, 5000])
def test_first_broken_field_at_any_width(spark, width):
    """Every place of a damage, in rows of any width, against a plain scan of the cells."""
    names = ["id", "start", "end"][: min(width, 3)] + [f"c{i}" for i in range(3, width)]
    good = ["P", "1", "2"][: min(width, 3)] + ["x"] * max(0, width - 3)
    places = range(width) if width < 10 else sorted({0, 1, 2, 3, 127, min(width, 129) - 1, 63, width - 2, width - 1})
    data, want = [(1, 1, "\t".join(names))], {}

    def row(cells, reason, at):
        data.append((1, len(data) + 1, "\t".join(cells)))
        want[len(data)] = (reason, at)

    row(good, None, None)
    row([*good, "x"], "column_count", width)
    for i in places:
        row([*good[:i], 'a"b', *good[i + 1 :]], "quoting", i + 1)
        if i < 3 and width > 1:  # an only cell that is empty makes a blank line
            row([*good[:i], "" if i == 0 else "ten", *good[i + 1 :]], "invalid_value", i + 1)
        if i:
            row(['"', *good[1:i]], "column_count", i + 1)
    if width > 3:
        row(["P", "ten", "2", 'a"', *good[4:]], "quoting", 4)
    got = {r["line_no"]: (r["reason"], r["broken_at"]) for r in parse(spark, data).collect()}
    assert got == want
