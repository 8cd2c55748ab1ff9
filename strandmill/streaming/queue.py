"""One load or deletion at a time, in the order they are asked for; and loading of a watched folder."""

from __future__ import annotations

import logging
import queue
import threading
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandmill.sources.loader import Loader

log = logging.getLogger(__name__)


class LoadQueue:
    """Jobs run on one thread; ``waiting`` is what isn't done yet; failures are logged, not raised."""

    def __init__(self, loader: Loader, listener: Callable[[list], None] | None = None):
        self.loader, self.listener = loader, listener
        self.waiting: list[tuple[str, dict]] = []
        self._jobs: queue.Queue = queue.Queue()
        self._lock = threading.Lock()
        self._thread = threading.Thread(target=self._work, daemon=True)
        self._thread.start()

    def put(self, path: str, always: bool = False, delete: bool = False) -> None:
        job = (path, {"always": always, "delete": delete})
        with self._lock:
            self.waiting.append(job)
        self._tell()
        self._jobs.put(job)

    def _tell(self) -> None:
        if self.listener:
            self.listener(list(self.waiting))

    def _work(self) -> None:
        while (job := self._jobs.get()) is not None:
            path, how = job
            try:
                self.loader.delete(path) if how["delete"] else self.loader.load(path, how["always"])
            except Exception:
                log.exception("loading %s", path)
            finally:
                with self._lock:
                    self.waiting.pop(0)
                self._tell()
                self._jobs.task_done()
        self._jobs.task_done()

    def join(self) -> None:
        """Wait until nothing is left to do."""
        self._jobs.join()

    def close(self) -> None:
        self._jobs.put(None)
        self._thread.join()


def watch(loads: LoadQueue, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Load every file that appears or changes below ``folder``.

    The stream carries paths and times only; the checkpoint remembers which
    files were seen, and the loader's hashes skip those that are unchanged.
    """
    spark = loads.loader.catalog.spark
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")

    def each(batch, _):
        # paths only; a sidecar stands for the file beside it
        for r in batch.select(F.regexp_replace("path", r"\.json$", "").alias("path")).distinct().toLocalIterator():
            loads.put(spark._jvm.org.apache.hadoop.fs.Path(r["path"]).toUri().getPath())

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
