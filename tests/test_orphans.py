from strandmill.operators.orphans import Reference, cascade, direct_orphans

C = "row_id int, ref string, key string, time timestamp"
P = "key string, live boolean, time timestamp"


def ref(spark, child, parent, **kw):
    c = spark.createDataFrame(child, C).selectExpr("row_id", "ref", "key", "time")
    return Reference("t", c, "t", spark.createDataFrame(parent, P), **kw)


def day(n):
    from datetime import datetime

    return None if n is None else datetime(2024, 1 + n, 15)


def test_kinds(spark):
    parent = [("a", True, day(2)), ("a", True, day(5)), ("b", False, day(0)), ("c", False, None), ("c", True, day(8)), (None, True, None)]
    child = [
        (1, "a", None, day(3)), (2, "a", None, day(1)), (3, "b", None, day(1)), (4, "c", None, day(1)), (5, "z", None, None), (6, None, None, day(1)),
        (7, "c", None, None), (5, "z", None, None),
    ]
    got = direct_orphans(ref(spark, child, parent, timed=True))
    assert sorted((r["row_id"], r["kind"], r["period"]) for r in got.collect()) == [
        (2, "late", "2024-02"), (3, "deleted", "2024-02"), (4, "late", "2024-02"), (5, "missing", None),
    ]
    assert {r["row_id"] for r in direct_orphans(ref(spark, child, parent)).collect()} == {3, 5}


def test_empty(spark):
    assert direct_orphans(ref(spark, [], [])).count() == 0
    assert direct_orphans(ref(spark, [(1, "a", None, None)], [])).collect()[0]["kind"] == "missing"
    assert cascade([ref(spark, [], [])]).count() == 0


def test_cascade_follows_chains_and_ends_in_cycles(spark):
    # 1 -> missing; 2 -> 1's key; 3 -> 2's key; 4 <-> 5 cycle, one of which hangs on 3; 6 is fine
    child = [(1, "gone", "k1", None), (2, "k1", "k2", None), (3, "k2", "k3", None), (4, "k5", "k4", None), (5, "k4", "k5", None), (5, "k3", "k5", None), (6, "root", "k6", None)]
    parent = [(k, True, None) for k in ("k1", "k2", "k3", "k4", "k5", "k6", "root")]
    got = cascade([ref(spark, child, parent)])
    assert sorted((r["row_id"], r["ref"], r["kind"], r["depth"]) for r in got.collect()) == [
        (1, "gone", "missing", 0), (2, "k1", "inherited", 1), (3, "k2", "inherited", 2), (4, "k5", "inherited", 4), (5, "k3", "inherited", 3), (5, "k4", "inherited", 5),
    ]


def test_cascade_by_row_id_and_clashing_columns(spark):
    a = ref(spark, [(7, "gone", "k", None)], [])
    b = Reference(
        "links", spark.createDataFrame([(1, 7, None, None, "x"), (2, 8, None, None, "x")], "row_id int, ref int, key string, time timestamp, kind string"), "t",
        spark.createDataFrame([(7, True, None), (8, True, None)], "key int, live boolean, time timestamp"), by="row_id",
    )
    got = cascade([a, b])
    assert sorted((r["table_name"], r["row_id"], r["kind"]) for r in got.collect()) == [("links", 1, "inherited"), ("t", 7, "missing")]


def test_late_targets_are_not_lost(spark):
    # 1 came before its target 2, which is lost itself: 1 is late and inherits, 3 inherits from it
    child = [(1, "k2", "k1", day(0)), (2, "gone", "k2", day(3)), (3, "k1", "k3", day(4)), (4, "k5", "k4", day(0)), (5, None, "k5", day(2)), (6, "k4", "k6", day(3))]
    parent = [("k1", True, day(0)), ("k2", True, day(3)), ("k3", True, day(4)), ("k4", True, day(0)), ("k5", True, day(2))]
    got = cascade([ref(spark, child, parent, timed=True)])
    assert sorted((r["row_id"], r["kind"], r["depth"]) for r in got.collect()) == [
        (1, "inherited", 1), (1, "late", 0), (2, "missing", 0), (3, "inherited", 2), (4, "late", 0),
    ]


def test_long_chains_and_null_ids(spark):
    n = 12
    child = [(i, f"k{i - 1}", f"k{i}", None) for i in range(1, n)] + [(None, "k3", None, None), (None, "gone", "k0", None), (None, "gone", "k0", None)]
    parent = [(f"k{i}", True, None) for i in range(n)]
    got = {(r["row_id"], r["ref"]): r["depth"] for r in cascade([ref(spark, child, parent)]).collect()}
    assert got == {(None, "gone"): 0, (None, "k3"): 4} | {(i, f"k{i - 1}"): i for i in range(1, n)}
