"""Session helpers: shared folder for intermediate tables, table access."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder is used in plain local
    mode only; a cluster without the setting is an error, because a
    machine-local folder would not be seen by other executors.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = tempfile.mkdtemp(prefix="strandmill-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


#: per thread: folders of the tables written inside its ``scratch`` blocks
_kept = threading.local()
#: folders that go when the application ends
_left: list[tuple[SparkSession, str]] = []


def own_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; it is deleted with its content when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_leave)
    _left.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _leave() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner
    true sizes for later joins. The files stay until the application ends, or
    the :func:`scratch` block that the call is in.
    """
    spark = df.sparkSession
    path = own_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    if blocks := getattr(_kept, "blocks", None):
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside the block when it ends; what is kept must have been stored elsewhere."""
    _kept.blocks = [*getattr(_kept, "blocks", []), []]
    try:
        yield
    finally:
        for path in _kept.blocks.pop():
            _delete(spark, path)
            _left[:] = [x for x in _left if x[1] != path]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, over at least as many partitions as there are cores.

    A scan that yields fewer, such as that of one small file, is redistributed;
    any larger input keeps its partitions and is not shuffled. Only the order
    of work changes by this, never a result.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
