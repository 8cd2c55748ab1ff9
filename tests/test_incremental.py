import random

import pytest

from strandmill.operators import manifests as M
from strandmill.operators.versioned import CommitConflict, VersionedTable, process_new

L = "run_id int, source_id int, name string, hash string"
R = "run_id int, status string"


def todo(spark, listing, runs, schema=L):
    m = M.build_manifests(spark.createDataFrame(listing, schema), "run_id", "name", "hash", "source_id")
    return sorted((r["version"], r["rec"]) for r in M.to_process(M.manifest_delta(m, spark.createDataFrame(runs, R))).collect())


def brute(listing, runs):
    ok = {r for r, s in runs if s == "ok"}
    known = {r for r, _ in runs}
    by = {}
    for r, i, n, h in listing:
        if None not in (r, i, n) and r in known:
            k = (r, n, None if h is None else h.lower())
            by[k] = min(i, by.get(k, i))
    out = []
    for (r, n, h), i in by.items():
        before = [q for (q, m, _) in by if m == n and q < r and q in ok]
        if not before or (max(before), n, h) not in by:
            out.append((r, i))
    return sorted(out)


def test_failed_runs_leave_nothing(spark):
    listing = [(1, 10, "f", "aa"), (2, 11, "f", "BB"), (3, 11, "f", "BB"), (4, 12, "f", "bb"), (5, 10, "f", "AA"), (5, 9, "f", "aa"), (5, 9, "f", "aa")]
    runs = [(1, "ok"), (2, "failed"), (3, "ok"), (4, None), (5, None)]
    assert todo(spark, listing, runs) == [(1, 10), (2, 11), (3, 11), (5, 9)] == brute(listing, runs)


def test_missing_listing_keeps_the_state(spark):
    listing = [(1, 1, "f", "a"), (3, 1, "f", "a"), (4, 2, "f", "b")]
    assert todo(spark, listing, [(1, "ok"), (2, "ok"), (3, "ok"), (4, "ok")]) == [(1, 1), (4, 2)]


def test_nulls_empty_and_clashing_columns(spark):
    assert todo(spark, [], [(1, "ok")]) == []
    assert todo(spark, [(1, 1, "f", "a")], []) == []
    listing = [(1, 1, "f", None), (2, 2, "f", None), (3, 3, "f", "x"), (None, 4, "f", "x"), (1, None, "g", "x"), (1, 5, None, "x")]
    runs = [(1, "ok"), (2, "ok"), (3, "ok")]
    assert todo(spark, listing, runs) == brute(listing, runs) == [(1, 1), (3, 3)]
    assert todo(spark, [(1, 1, "f", "a", 7, "z")], [(1, "ok")], L + ", version int, path string") == [(1, 1)]


def test_delta_names_every_change(spark):
    listing = [(1, 1, "f", "a"), (1, 2, "g", "a"), (2, 1, "f", "a"), (2, 3, "g", "b"), (2, 4, "h", "c"), (2, 5, "h", "c")]
    df = spark.createDataFrame(listing, L)
    m = M.build_manifests(df, "run_id", "name", "hash", "source_id")
    d = M.manifest_delta(m, spark.createDataFrame([(1, "ok"), (2, "ok")], R))
    assert sorted((r["version"], r["path"], r["change"], r["rec"]) for r in d.collect()) == [
        (1, "f", "added", 1), (1, "g", "added", 2), (2, "f", "unchanged", 1), (2, "g", "changed", 3), (2, "g", "removed", 2), (2, "h", "added", 4),
    ]
    dv = M.deletion_vectors(m)
    assert [(r["version"], r["path"], r["rec"]) for r in dv.collect()] == [(2, "h", 5)]


def test_against_brute_force(spark):
    rnd = random.Random(1)
    listing = [(rnd.randrange(1, 9), rnd.randrange(30), "hot" if rnd.random() < 0.4 else f"f{rnd.randrange(6)}", rnd.choice(["a", "A", "b", None])) for _ in range(600)]
    runs = [(i, rnd.choice(["ok", "failed", None])) for i in range(1, 9)]
    assert todo(spark, listing, runs) == brute(listing, runs)


# -- tables of files --------------------------------------------------------------
@pytest.fixture
def tables(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "in")), VersionedTable(spark, str(tmp_path / "out"))


def ids(df):
    return sorted(r[0] for r in df.collect()) if df is not None else []


def test_versions_files_and_deletion_vectors(spark, tables):
    t, _ = tables
    assert t.commit(spark.range(0, 4, 1, 1)) == 0
    first = t.manifest(0)["files"][0]
    t.commit(spark.range(10, 12, 1, 1))
    t.commit(mask={first: [1, 2]})
    assert ids(t.read()) == [0, 3, 10, 11] and ids(t.read(0)) == [0, 1, 2, 3] and ids(t.read(1)) == [0, 1, 2, 3, 10, 11]
    t.commit(remove=[first])
    assert ids(t.read()) == [10, 11]
    change = lambda a, b: sorted((r["id"], r["_change"]) for r in t.changes(a, b).collect())
    assert change(0, 1) == [(10, "added"), (11, "added")]
    assert change(1, 2) == [(1, "removed"), (2, "removed")]
    assert change(2, 3) == [(0, "removed"), (3, "removed")]
    assert change(-1, 2) == [(0, "added"), (3, "added"), (10, "added"), (11, "added")]
    assert t.changes(3, 3) is None


def test_each_record_once_through_failures(spark, tables):
    src, out = tables
    add = lambda d: d.where("_change = 'added'").drop("_change")
    src.commit(spark.range(0, 3, 1, 1))
    src.commit(spark.range(3, 5, 1, 1))
    assert process_new(src, out, add) == 0 and ids(out.read()) == [0, 1, 2, 3, 4]
    assert process_new(src, out, add) is None
    src.commit(spark.range(5, 7, 1, 1))

    def breaks(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_new(src, out, breaks)
    assert out.manifest(out.latest())["processed"] == 1
    # another writer commits in between: this one must not
    def meddles(d):
        process_new(src, out, add)
        return add(d)

    with pytest.raises(CommitConflict):
        process_new(src, out, meddles)
    assert ids(out.read()) == list(range(7)) and out.manifest(out.latest())["processed"] == 2
    assert process_new(src, out, add) is None


def test_a_rewrite_is_no_change(spark, tables):
    t, out = tables
    t.commit(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, x string").coalesce(1))
    first = t.manifest(0)["files"]
    t.commit(t.read().repartition(3), remove=first)
    assert t.changes(0, 1).count() == 0
    # a rewrite that changes one of two equal records
    t.commit(spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id int, x string"), remove=t.manifest(1)["files"])
    assert sorted((r["id"], r["x"], r["_change"]) for r in t.changes(0, 2).collect()) == [(1, "a", "removed"), (1, "b", "added")]
    assert process_new(t, out, lambda d: d.where("_change = 'added'").drop("_change")) == 0 and out.read().count() == 3


def test_masks_meet_only_their_own_file(spark, tables):
    t, _ = tables
    t.commit(spark.range(0, 5, 1, 1))
    t.commit(spark.range(10, 15, 1, 1))
    a, b = t.manifest(1)["files"]
    t.commit(mask=spark.createDataFrame([(a, 0), (b, 4), (a, 0)], "file string, row long"))
    assert ids(t.read()) == [1, 2, 3, 4, 10, 11, 12, 13]
    t.commit(mask={a: [0, 1]})  # masked again: no new change
    assert sorted(r["id"] for r in t.changes(2, 3).collect()) == [1]
    t.commit(remove=[a, b])
    assert t.read().count() == 0 and t.read().columns == ["id"] and t.manifest(4)["masks"] == {}


def test_plans_cover_each_version_once(spark, tables):
    listed, work = tables
    runs = [(1, "ok"), (2, "failed"), (3, "ok"), (4, None)]
    listing = [(1, 10, "f", "aa"), (2, 11, "f", "BB"), (3, 11, "f", "BB"), (3, 12, "f", "bb"), (4, 13, "g", "c"), (4, 11, "f", "bb")]
    got = lambda: sorted((r["version"], r["rec"]) for r in M.to_process(work.read()).collect())
    for upto in (2, 3, 4):  # one run after the other, and each listing seen again
        M.publish(listed, spark.createDataFrame([x for x in listing if x[0] <= upto], L), "run_id", "name", "hash", "source_id")
        assert M.plan_runs(listed, work, spark.createDataFrame(runs, R)) is not None
        assert M.plan_runs(listed, work, spark.createDataFrame(runs, R)) is None
        assert got() == brute([x for x in listing if x[0] <= upto], runs)
    assert work.manifest(work.latest())["processed"] == listed.latest() == 2


def test_a_killed_plan_is_made_again(spark, tables, monkeypatch):
    listed, work = tables
    M.publish(listed, spark.createDataFrame([(1, 10, "f", "aa"), (2, 11, "f", "b")], L), "run_id", "name", "hash", "source_id")
    runs = spark.createDataFrame([(1, "ok"), (2, "ok")], R)
    with monkeypatch.context() as m:
        m.setattr(work._files, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            M.plan_runs(listed, work, runs)
    assert work.latest() == -1
    assert M.plan_runs(listed, work, runs) == 0 and work.read().count() == 3  # two added, one removed


def test_files_appear_whole_and_once(spark, tmp_path):
    from strandmill.sources.files import Files

    f, at = Files(spark), str(tmp_path / "x.json")
    assert f.create(at, "one") and not f.create(at, "two") and f.text(at) == "one"
    f.write(at, "three")
    assert f.text(at) == "three" and f.names(str(tmp_path)) == ["x.json"]
