"""Loading of files into the catalog: change detection, status, storage, deletion.

A load writes new files first and then replaces the dataset's entry in one
step, so queries see the old dataset until the new one is complete. Files that
no entry names any more stay for frames that were handed out before;
:meth:`Loader.vacuum` deletes them.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid

from pyspark.sql import functions as F

from strandmill.catalog import ROW, Catalog, Dataset, Field, LoadError
from strandmill.session import scratch
from strandmill.sources import metadata as md
from strandmill.sources import readers
from strandmill.sources.files import Files

MAX_WARNINGS = 10
MATRIX = {"genomic", "tsv"}


def shorten(warnings: dict) -> dict:
    """At most ``MAX_WARNINGS`` names of each kind."""
    return {
        k: {x: list(y)[:MAX_WARNINGS] for x, y in v.items()} if isinstance(v, dict) else list(v)[:MAX_WARNINGS] for k, v in warnings.items()
    }


class Loader:
    """Loads files below ``docroot`` into ``catalog``; tables are kept below ``store``."""

    def __init__(self, catalog: Catalog, docroot: str, store: str):
        self.catalog, self.docroot, self.store = catalog, docroot.rstrip("/"), store.rstrip("/")
        self.files = Files(catalog.spark)

    # -- names -------------------------------------------------------------
    def name_of(self, path: str) -> str:
        return md.relative(self.docroot, path if path.startswith("/") else posixpath.join(self.docroot, path))

    def _entry(self, name: str) -> str:
        return f"{self.store}/catalog/{hashlib.sha1(name.encode()).hexdigest()}.json"

    # -- loading -------------------------------------------------------------
    def load(self, path: str, always: bool = False) -> Dataset | None:
        """Load a file; None if it is of no kind that is loaded by itself.

        Metadata are always updated. Data are read again only if the set of
        (name, time, hash) of the files behind the dataset has changed, or
        ``always``. A failure leaves the dataset with status ``error`` and the
        reason in its metadata.
        """
        name = self.name_of(path)
        full = posixpath.join(self.docroot, name)
        kind = md.detect(self.files, full)
        if kind is None or kind == "feature":
            return None
        meta = md.sidecar(self.files, full) or {}
        refs = md.references(self.docroot, name, meta)
        metadata = md.canonical({**meta, **refs})
        behind = [name]
        feature_file = refs.get(":clinicalFeature")
        features: dict = {}
        if feature_file and kind in MATRIX | {"clinical"} and self.files.exists(posixpath.join(self.docroot, feature_file)):
            behind = [feature_file, name]
        sources = [self.files.stats(posixpath.join(self.docroot, b), b) for b in behind]
        old = self.catalog.datasets.get(name)
        if old is not None and not always and old.meta.get("status") == "loaded" and same_sources(old.meta.get("sources", []), sources):
            old.meta["metadata"] = {**metadata, **({"loader": old.meta["metadata"]["loader"]} if "loader" in old.meta["metadata"] else {})}
            self._save(old)
            return old
        dataset_id = old.meta["id"] if old is not None else None
        if old is not None:
            old.meta["status"] = "loading"
        try:
            if feature_file in behind:
                features = md.parse_features(self.files.text(posixpath.join(self.docroot, feature_file)))
            with scratch(self.catalog.spark):
                ds = self._read(kind, full, name, features, int(meta.get("start_index", 1)))
        except Exception as e:
            ds = Dataset(name, {}, df=self.catalog.spark.createDataFrame([], f"{ROW} long"), meta={"status": "error", "metadata": {**metadata, "error": str(e)}})
        else:
            if warn := ds.meta.pop("warnings", None):
                metadata["loader"] = shorten(warn)
            ds.meta |= {"status": "loaded", "metadata": metadata}
        ds.meta["sources"] = sources
        if dataset_id is not None:
            ds.meta["id"] = dataset_id
        self.catalog.add(ds)
        self._save(ds)
        return ds

    def _read(self, kind: str, path: str, name: str, features: dict, start_index: int) -> Dataset:
        spark = self.catalog.spark
        at = f"{self.store}/data/{uuid.uuid4().hex}"
        if kind in MATRIX:
            parsed = readers.read_matrix(spark, path, name, features)
            ds = parsed.dataset
            # sorted by field, so a lookup of fields reads few row groups
            ds.values.repartitionByRange("field").sortWithinPartitions("field").write.parquet(f"{at}/values")
            ds.samples.write.parquet(f"{at}/samples")
            ds.samples = spark.read.parquet(f"{at}/samples")
            readers.finish_matrix(parsed, spark.read.parquet(f"{at}/values"))
            count = ds.meta["rows"]
        else:
            parsed = readers.read_clinical(spark, path, name, features) if kind == "clinical" else readers.read_map(spark, path, name, kind, start_index)
            ds = parsed.dataset
            ds.df.sortWithinPartitions(ROW).write.parquet(f"{at}/rows")
            ds.df = spark.read.parquet(f"{at}/rows")
            ds.codes = readers.table_codes(ds)
            count = ds.df.agg(F.coalesce(F.max(ROW) + 1, F.lit(0))).first()[0]
        if ds.codes is not None:
            ds.codes.write.parquet(f"{at}/codes")
            ds.codes = spark.read.parquet(f"{at}/codes")
        ds.meta = {"rows": int(count), "data": at, "warnings": parsed.warnings}
        return ds

    def delete(self, path: str) -> bool:
        """Remove a dataset; False if there is none of this name. Its files go with :meth:`vacuum`."""
        name = self.name_of(path)
        ds = self.catalog.datasets.get(name)
        if ds is None:
            return False
        ds.meta["status"] = "deleting"
        self.files.delete(self._entry(name))
        self.catalog.delete(name)
        return True

    def vacuum(self) -> list[str]:
        """Delete the files of replaced and deleted datasets; the names of their folders.

        To be called when no frame made before the last load or deletion is in use.
        """
        used = {posixpath.basename(d.meta["data"]) for d in self.catalog.datasets.values() if d.meta.get("data")}
        old = [n for n in self.files.names(f"{self.store}/data") if n not in used]
        for n in old:
            self.files.delete(f"{self.store}/data/{n}")
        return old

    def drop_dangling(self) -> list[str]:
        """Delete the datasets whose probe map is not in the catalog; their names."""
        known = set(self.catalog.datasets)
        lost = [n for n, d in self.catalog.datasets.items() if (p := d.meta.get("metadata", {}).get("probeMap")) and str(p).lstrip("/") not in known]
        for n in lost:
            self.delete(n)
        return lost

    # -- catalog on disk -------------------------------------------------------
    def _save(self, ds: Dataset) -> None:
        doc = {
            "name": ds.name, "matrix": ds.is_matrix, "coded": ds.codes is not None,
            "meta": {k: v for k, v in ds.meta.items() if k != "features"},
            "fields": [[f.name, f.type, f.id, f.feature] for f in ds.fields.values()],
        }
        self.files.write(self._entry(ds.name), json.dumps(doc, default=str))

    def reopen(self) -> None:
        """Bring the catalog back from the store."""
        from datetime import datetime

        spark = self.catalog.spark
        for entry in self.files.names(f"{self.store}/catalog"):
            if not entry.endswith(".json"):
                continue
            doc = json.loads(self.files.text(f"{self.store}/catalog/{entry}"))
            at = doc["meta"].get("data")
            ds = Dataset(doc["name"], {n: Field(n, t, i, f) for n, t, i, f in doc["fields"]}, meta=doc["meta"])
            for s in ds.meta.get("sources", []):
                s["time"] = datetime.fromisoformat(s["time"])
            if at is None:
                ds.df = spark.createDataFrame([], f"{ROW} long")
            elif doc["matrix"]:
                ds.values, ds.samples = spark.read.parquet(f"{at}/values").select("field", "values", "codes"), spark.read.parquet(f"{at}/samples")
            else:
                ds.df = spark.read.parquet(f"{at}/rows")
            if at is not None and doc["coded"]:
                ds.codes = spark.read.parquet(f"{at}/codes")
            self.catalog.datasets[ds.name] = ds
            self.catalog._next["dataset"] = max(self.catalog._next["dataset"], ds.meta["id"] + 1)
            self.catalog._next["field"] = max([self.catalog._next["field"], *(f.id + 1 for f in ds.fields.values())])


def same_sources(a: list[dict], b: list[dict]) -> bool:
    key = lambda s: (s["name"], str(s["time"]), s["hash"])
    return set(map(key, a)) == set(map(key, b))


def write_dataset(catalog: Catalog, name: str, df, order: list[str] | None = None, types: dict[str, str] | None = None, **meta) -> Dataset:
    """Register a DataFrame as a dataset with its codes, for data that are no files."""
    old = catalog.datasets.get(name)
    ds = catalog.register(name, df, order, types, **({"id": old.meta["id"]} if old else {}), **meta)
    ds.codes = readers.table_codes(ds)
    return ds


__all__ = ["LoadError", "Loader", "same_sources", "shorten", "write_dataset"]
