"""A table of immutable versions on disk, and exactly-once processing of its changes.

Layout of a table::

    data/<id>/*.parquet          immutable record files
    masks/<id>/*.parquet         deletion vectors: file and row of the records that are dead
    log/<version>.json           manifest: files and deletion vectors of that version

A commit appears by creating its manifest under a name that must not exist yet.
The output of an incremental job is a table of the same kind whose manifests
carry ``processed``, the input version that commit covers: output and progress
are one file, so a run that dies before its commit leaves nothing that counts,
and one that dies after it is not repeated.

A manifest names files and folders, as any reader of the table must; records
and deletion vectors never reach the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.sources.files import Files

MASK = "file string, row long"


class CommitConflict(Exception):
    """Another writer made this version first."""


class VersionedTable:
    """A table whose versions list files and deletion vectors."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._files = spark, path.rstrip("/"), Files(spark)

    # -- manifests -------------------------------------------------------
    def versions(self) -> list[int]:
        names = self._files.names(f"{self.path}/log")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int) -> dict:
        """``files``, ``masks`` (folder -> the files it masks rows of), ``processed``, ``schema`` and ``about`` of a version."""
        if version < 0:
            return {"files": [], "masks": {}, "processed": -1, "schema": None, "about": {}}
        return json.loads(self._files.text(f"{self.path}/log/{version:012d}.json"))

    def latest(self) -> int:
        return (self.versions() or [-1])[-1]

    # -- writing ---------------------------------------------------------
    def _write(self, df: DataFrame, kind: str) -> str:
        part = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def commit(
        self,
        add: DataFrame | None = None,
        remove: list[str] | None = None,
        mask: DataFrame | dict[str, list[int]] | None = None,
        processed: int | None = None,
        on: int | None = None,
        about: Callable[[DataFrame], dict] | None = None,
    ) -> int:
        """Next version: new files, files left out, and rows masked (``file``, ``row``); raises if the version exists by then.

        ``about`` tells from the rows as they were written what else the manifest holds.
        """
        base = self.latest() if on is None else on
        old = self.manifest(base)
        gone = set(remove or [])
        files, told = [f for f in old["files"] if f not in gone], {}
        masks, schema = dict(old["masks"]), old["schema"]
        if isinstance(mask, dict):
            mask = self.spark.createDataFrame([(f, r) for f, v in mask.items() for r in v], MASK)
        if mask is not None:
            part = self._write(mask.select("file", F.col("row").cast("long").alias("row")).distinct(), "masks")
            masks[part] = sorted(r[0] for r in self.spark.read.schema(MASK).parquet(f"{self.path}/{part}").select("file").distinct().toLocalIterator())
        if add is not None:
            part = self._write(add, "data")
            files += [f"{part}/{n}" for n in self._files.names(f"{self.path}/{part}") if n.endswith(".parquet")]
            schema = schema or add.schema.jsonValue()
            told = about(self.spark.read.schema(add.schema).parquet(f"{self.path}/{part}")) if about else {}
        masks = {p: [f for f in fs if f not in gone] for p, fs in masks.items()}
        new = {
            "files": files, "masks": {p: fs for p, fs in masks.items() if fs}, "schema": schema, "about": told,
            "processed": old["processed"] if processed is None else processed,
        }
        if not self._files.create(f"{self.path}/log/{base + 1:012d}.json", json.dumps(new, sort_keys=True)):
            raise CommitConflict(f"version {base + 1} exists")
        return base + 1

    # -- reading ---------------------------------------------------------
    def _rows(self, files: list[str]) -> DataFrame:
        df = self.spark.read.parquet(*[f"{self.path}/{f}" for f in files])
        at = F.regexp_extract("_metadata.file_path", r"data/[^/]+/[^/]+$", 0)
        return df.select("*", at.alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def _masks(self, masks: dict[str, list[str]], files: list[str]) -> DataFrame | None:
        among = set(files)
        parts = [p for p, fs in masks.items() if among & set(fs)]
        if not parts:
            return None
        df = self.spark.read.schema(MASK).parquet(*[f"{self.path}/{p}" for p in parts])
        return df.select(F.col("file").alias("__file"), F.col("row").alias("__row")).distinct()

    def _live(self, files: list[str], masks: dict[str, list[str]]) -> DataFrame:
        """Records of the files that no deletion vector masks; the vectors are broadcast only if the planner finds them small."""
        m = self._masks(masks, files)
        if m is None:
            return self.spark.read.parquet(*[f"{self.path}/{f}" for f in files])
        return self._rows(files).join(m, ["__file", "__row"], "left_anti").drop("__file", "__row")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The live records of a version; None if nothing was ever added to it."""
        m = self.manifest(self.latest() if version is None else version)
        if m["files"]:
            return self._live(m["files"], m["masks"])
        return None if m["schema"] is None else self.spark.createDataFrame([], T.StructType.fromJson(m["schema"]))

    def changes(self, since: int, until: int) -> DataFrame | None:
        """Records added and removed between two versions, with ``_change``; None if the manifests are the same.

        Only files that differ between the two manifests are read: added files
        yield their live rows, removed files the rows that were live, files
        with a longer deletion vector the newly masked rows. What is in both
        lists is no change, as often as it is in both: a compaction, which
        writes the same records to new files, yields nothing. Columns of map
        type can't be compared.
        """
        a, b = self.manifest(since), self.manifest(until)
        old, new = set(a["files"]), set(b["files"])
        fresh, gone, kept = [f for f in b["files"] if f not in old], [f for f in a["files"] if f not in new], old & new
        added = self._live(fresh, b["masks"]) if fresh else None
        removed = [self._live(gone, a["masks"])] if gone else []
        longer = {p: [f for f in fs if f in kept] for p, fs in b["masks"].items() if p not in a["masks"]}
        touched = sorted({f for fs in longer.values() for f in fs})
        if touched:
            now = self._masks(longer, touched)
            before = self._masks(a["masks"], touched)
            now = now if before is None else now.join(before, ["__file", "__row"], "left_anti")
            removed.append(self._rows(touched).join(now, ["__file", "__row"], "left_semi").drop("__file", "__row"))
        lost = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), removed) if removed else None
        if added is not None and lost is not None:
            names = list(dict.fromkeys([*added.columns, *lost.columns]))
            full = lambda x: x.select(*[F.col(f"`{n}`") if n in x.columns else F.lit(None).alias(n) for n in names])
            added, lost = full(added), full(lost)
            added, lost = added.exceptAll(lost), lost.exceptAll(added)
        parts = [x.withColumn("_change", F.lit(what)) for x, what in ((added, "added"), (lost, "removed")) if x is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None


def process_new(
    source: VersionedTable, sink: VersionedTable, transform: Callable[[DataFrame], DataFrame], upto: int | None = None
) -> int | None:
    """Run ``transform`` over the changes the sink has not seen; returns the sink's new version.

    None if there is nothing new. A failure in ``transform`` or in writing
    leaves the sink's progress as it was; two runs at once cannot both commit.
    """
    base = sink.latest()
    done = sink.manifest(base)["processed"]
    upto = source.latest() if upto is None else upto
    if upto <= done:
        return None
    delta = source.changes(done, upto)
    return sink.commit(None if delta is None else transform(delta), processed=upto, on=base)
