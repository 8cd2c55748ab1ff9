"""Incremental processing by differences of immutable table versions.

Every run's listing is a version of a table. Its *files* are (path,
fingerprint), where equal content has an equal fingerprint; its *records* are
the ids listed for a file. Of several records of one file the smallest is live,
the others are masked by the version's *deletion vector*. :func:`publish`
writes the records of all versions once and commits a manifest for each;
:func:`manifest_delta` compares the manifest of a version with that of the last
successful version of each path: files only in the new one are added, files
only in the old one are removed, and the deletion vectors tell which records
these stand for. :func:`plan_runs` commits the records that each run has to
process, together with the last version they cover, to a table of the same
kind: a plan that dies before its commit leaves nothing, one that has committed
is never made again.

A version whose run did not succeed leaves no state, so nothing of it is
skipped later or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.versioned import VersionedTable


def build_manifests(listing: DataFrame, version: str, path: str, fingerprint: str, rec: str) -> DataFrame:
    """The records of all versions: ``version``, ``path``, ``fingerprint``, ``rec``, ``dead`` (masked by the deletion vector).

    Fingerprints are compared without letter case. Repeated rows count once;
    rows with a NULL version, path or record belong to no manifest; a NULL
    fingerprint is a content of its own. Other columns are dropped. Files are
    folded to their least record before they shuffle; only the records of files
    that have several meet them again, so a file with very many records never
    lies in one task.
    """
    rows = (
        listing.select(
            F.col(version).cast("long").alias("version"), F.col(path).cast("string").alias("path"), content(F.col(fingerprint)).alias("c"), F.col(rec).cast("long").alias("rec")
        )
        .where("version is not null and path is not null and rec is not null")
    )
    files = rows.groupBy("version", "path", "c").agg(F.min("rec").alias("rec"), F.max("rec").alias("most"))
    several = files.where("rec < most").select("version", "path", "c", F.col("rec").alias("least"))
    masked = rows.join(several, ["version", "path", "c"]).where("rec > least").select("version", "path", "c", "rec").distinct()
    both = files.select("version", "path", "c", "rec", F.lit(False).alias("dead")).unionByName(masked.withColumn("dead", F.lit(True)))
    return both.select("version", "path", told(F.col("c")).alias("fingerprint"), "rec", "dead")


def content(fingerprint: Column) -> Column:
    """A fingerprint as a text that is never NULL, so that equal contents are equal in joins and groups."""
    return F.coalesce(F.concat(F.lit("="), F.lower(fingerprint)), F.lit(""))


def told(c: Column) -> Column:
    """The fingerprint of such a text."""
    return F.when(c != "", F.substring(c, 2, 2**31 - 1))


def deletion_vectors(manifests: DataFrame) -> DataFrame:
    """The masked records of each version: ``version``, ``path``, ``fingerprint``, ``rec``."""
    return manifests.where("dead").drop("dead")


def publish(source: VersionedTable, listing: DataFrame, version: str, path: str, fingerprint: str, rec: str) -> int:
    """Write the records of the versions the table does not have yet and commit their manifests as one; the last version.

    The versions that a commit holds are in its ``about``. Listing the same
    version again adds nothing.
    """
    done = max((v for n in source.versions() for v in source.manifest(n)["about"]["versions"]), default=None)
    new = listing if done is None else listing.where(F.col(version) > done)
    held = lambda rows: {"versions": sorted(r[0] for r in rows.select("version").distinct().collect())}  # noqa: E731 - one a run
    return source.commit(build_manifests(new, version, path, fingerprint, rec), about=held)


def manifest_delta(manifests: DataFrame, runs: DataFrame, version: str = "run_id", status: str = "status", after: int | None = None) -> DataFrame:
    """What each run has to do: ``version``, ``path``, ``fingerprint``, ``rec``, ``change``.

    The manifest of every version (beyond ``after``) is compared, path by path,
    with the manifest of the last successful version before it that lists the
    path. A file in both is ``unchanged``; one that only the new one has is
    ``added`` if no earlier version counts for its path, else ``changed``; one
    that only the old one has is ``removed`` (``rec`` is the old record). Files
    stand for their live records. A path that a version does not list keeps its
    state. Versions without a run are no versions. A run succeeded only if its
    status is ``ok``; a run listed twice succeeded if one of its rows says so.
    Empty manifests give no rows.

    Manifests are turned around first: a file has the list of the versions that
    list it, a path the list of its versions and their bases. Each pair of
    manifests is then compared where the file is, so a file that stays through
    many versions is one row until it changes. These lists are as long as there
    are versions.
    """
    ok = runs.where(F.col(version).isNotNull()).groupBy(F.col(version).cast("long").alias("version")).agg(
        F.max(F.coalesce(F.col(status) == "ok", F.lit(False))).alias("ok")
    )
    live = manifests.where(~F.col("dead")).select("version", "path", content(F.col("fingerprint")).alias("c"), "rec")
    # grows with the number of runs only; the planner broadcasts it after a check of its size
    files = live.join(ok, "version").groupBy("path", "c").agg(F.collect_list(F.struct("version", "ok", "rec")).alias("listed"))
    versions = F.transform("listed", lambda x: F.struct(x["version"].alias("version"), x["ok"].alias("ok")))
    # a set per path, merged before it shuffles: as long as there are versions, however many files a path has
    of_path = files.select(F.col("path").alias("p"), F.explode(versions).alias("v")).groupBy("p").agg(F.collect_set("v").alias("all"))
    good = F.transform(F.filter("all", lambda x: x["ok"]), lambda x: x["version"])
    base = lambda v: F.array_max(F.filter("good", lambda g: g < v))
    bases = of_path.select("p", good.alias("good"), F.transform("all", lambda x: x["version"]).alias("vs")).select(
        "p", F.transform("vs" if after is None else F.filter("vs", lambda v: v > after), lambda v: F.struct(v.alias("version"), base(v).alias("base"))).alias("pairs")
    )
    by_version = F.map_from_entries(F.transform("listed", lambda x: F.struct(x["version"], x["rec"])))
    at = lambda v: F.when(v.isNotNull(), F.try_element_at(F.col("recs"), v))
    pairs = F.transform("pairs", lambda x: F.struct(x["version"].alias("version"), x["base"].isNotNull().alias("had"), at(x["version"]).alias("new"), at(x["base"]).alias("old")))
    both = (
        files.select("path", "c", by_version.alias("recs"))
        .join(bases, F.col("path") == F.col("p"))
        .select("path", "c", F.explode(F.filter(pairs, lambda x: x["new"].isNotNull() | x["old"].isNotNull())).alias("x"))
        .select("path", "c", "x.*")
    )
    change = (
        F.when(F.col("new").isNull(), "removed").when(F.col("old").isNotNull(), "unchanged").when(F.col("had"), "changed").otherwise("added")
    )
    return both.select("version", "path", told(F.col("c")).alias("fingerprint"), F.coalesce("new", "old").alias("rec"), change.alias("change"))


def plan_runs(source: VersionedTable, sink: VersionedTable, runs: DataFrame, version: str = "run_id", status: str = "status") -> int | None:
    """Commit what the runs of the versions that ``sink`` has not seen have to do; the sink's new version, None if there is nothing new.

    The commit holds the rows of :func:`manifest_delta` but the unchanged ones
    (whose number is that of the listed files less those added and changed) and
    ``processed``, the source version it covers. It reads the manifests of
    all versions, as any of them can be the base of a path.
    """
    base = sink.latest()
    done, upto = sink.manifest(base)["processed"], source.latest()
    if upto <= done:
        return None
    seen = max((v for n in range(done + 1) for v in source.manifest(n)["about"]["versions"]), default=None)
    delta = manifest_delta(source.read(upto), runs, version, status, after=seen).where("change <> 'unchanged'")
    return sink.commit(delta, processed=upto, on=base)


def to_process(delta: DataFrame) -> DataFrame:
    """The added and changed records of every run: ``version``, ``path``, ``fingerprint``, ``rec``, ``change``."""
    return delta.where(F.col("change").isin("added", "changed"))
