"""Files through Hadoop's file system, so that paths may be local or remote."""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Files:
    spark: SparkSession

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def text(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _draft(self, path: str, text: str):
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        p, fs = self._at(draft)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        return draft, p, fs

    def _rename(self, old, new, how: str) -> None:
        """Hadoop's rename with a stated rule for a file of the new name: ``NONE`` refuses, ``OVERWRITE`` replaces in one step."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rules = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        rules[0] = getattr(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), how)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark._jsc.hadoopConfiguration()).rename(old, new, rules)

    def write(self, path: str, text: str) -> None:
        """Appears under its name only when it is complete; a file of that name is replaced in one step, never missing."""
        draft, p, fs = self._draft(path, text)
        try:
            if fs.getScheme() == "file":
                os.replace(*(x.toUri().getPath() for x in (p, self._at(path)[0])))
            else:
                self._rename(p, self._at(path)[0], "OVERWRITE")
        finally:
            fs.delete(p, False)

    def create(self, path: str, text: str) -> bool:
        """Write a file unless there is one of that name; False if there is. Of several writers at once one succeeds.

        Local file systems link the finished file to its name, HDFS renames it
        by a rule that refuses to replace; other stores are asked to create the
        object if it is absent, which they do when it is closed.
        """
        final, fs = self._at(path)
        if fs.exists(final):
            return False
        if fs.getScheme() not in ("file", "hdfs", "viewfs"):
            try:
                out = fs.create(final, False)
                out.write(bytearray(text.encode()))
                out.close()
            except Py4JJavaError:
                if fs.exists(final):
                    return False
                raise
            return True
        _, p, fs = self._draft(path, text)
        try:
            if fs.getScheme() == "file":
                os.link(*(x.toUri().getPath() for x in (p, final)))
            else:
                self._rename(p, final, "NONE")
        except (FileExistsError, Py4JJavaError):
            if fs.exists(final):
                return False
            raise
        finally:
            fs.delete(p, False)
        return True

    def write_lines(self, path: str, head: str, rows: DataFrame, *order: str) -> None:
        """One text file: ``head``, then the column ``line`` of a frame in the given order; sorted and written by one task."""
        top = self.spark.createDataFrame([(0, head)], "__g int, line string")
        body = rows.select(F.lit(1).alias("__g"), "line", *order)
        at = f"{path}.{uuid.uuid4().hex}.parts"
        both = top.unionByName(body, allowMissingColumns=True).repartition(1).sortWithinPartitions("__g", *order)
        both.select("line").write.text(at)
        for part in self.names(at):
            if part.startswith("part-"):
                old, fs = self._at(f"{at}/{part}")
                fs.rename(old, self._at(path)[0])
        self.delete(at)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def walk(self, path: str) -> list[str]:
        """All files below a folder."""
        p, fs = self._at(path)
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            out.append(it.next().getPath().toUri().getPath())
        return sorted(out)

    def stats(self, path: str, name: str) -> dict:
        """Name, time of the last change and SHA-1 of a file, read in pieces."""
        p, fs = self._at(path)
        when = datetime.fromtimestamp(fs.getFileStatus(p).getModificationTime() / 1000, UTC).replace(microsecond=0, tzinfo=None)
        sha = hashlib.sha1()
        if fs.getScheme() == "file" and os.path.exists(path):
            with open(path, "rb") as f:
                while piece := f.read(1 << 20):
                    sha.update(piece)
        else:
            stream = fs.open(p)
            while piece := bytes(stream.readNBytes(1 << 20)):
                sha.update(piece)
            stream.close()
        return {"name": name, "time": when, "hash": sha.hexdigest()}
