"""Counts over a folder that grows, batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class FolderCounts:
    """Rows per key of all files that ever appeared in a folder.

    Every micro-batch writes its partial counts under its own number, so a
    batch that is run again after a failure replaces itself and counts once.
    ``state`` is a folder in the shared file system for the checkpoint and the
    partial counts.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, state: str, by: list[str], latest: str | None = None, glob: str = "*.parquet"):
        self.spark, self.folder, self.schema, self.state, self.by, self.latest, self.glob = spark, folder, schema, state.rstrip("/"), by, latest, glob

    def _partial(self, batch: DataFrame, batch_id: int) -> None:
        aggs: list[Column] = [F.count("*").alias("n")]
        if self.latest:
            aggs.append(F.max(self.latest).alias("last"))
        batch.groupBy(*self.by).agg(*aggs).write.mode("overwrite").parquet(f"{self.state}/counts/batch={batch_id}")

    def update(self) -> None:
        """Count the files that are new since the last call."""
        rows = self.spark.readStream.schema(self.schema).option("pathGlobFilter", self.glob).load(self.folder)
        query = rows.writeStream.foreachBatch(self._partial).option("checkpointLocation", f"{self.state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def read(self) -> DataFrame:
        """``by``, ``n`` and, if it was asked for, ``last``: the greatest value of the column ``latest``."""
        keys = [self.schema[b] for b in self.by]
        kinds = ", ".join([*(f"`{k.name}` {k.dataType.simpleString()}" for k in keys), "n long", *([f"last {self.schema[self.latest].dataType.simpleString()}"] if self.latest else [])])
        parts = self.spark.read.schema(kinds).parquet(f"{self.state}/counts")
        return parts.groupBy(*self.by).agg(F.sum("n").alias("n"), *([F.max("last").alias("last")] if self.latest else []))
