"""A log of commits in a folder: numbered files, each of which appears finished and once only."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    """``folder/<number>`` holds commit <number> as JSON. Making one is a hard link on local disks and elsewhere a rename that refuses to
    overwrite, so that of two writers with one number the second fails."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def entries(self) -> list[dict]:
        """All commits, oldest first."""
        at = self._path(self.folder)
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return [json.loads(self._read(f"{self.folder}/{n}")) for n in sorted((n for n in names if n.isdigit()), key=int)]

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def append(self, number: int, entry: dict) -> None:
        """Makes commit ``number``; RuntimeError if it exists."""
        final, part = f"{self.folder}/{number:012d}", f"{self.folder}/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(part), False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(self._path(part).toUri().getPath(), self._path(final).toUri().getPath())
            else:
                rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                flags = self.spark.sparkContext._gateway.new_array(rename, 1)
                flags[0] = rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(part), self._path(final), flags)
        except Exception as e:
            raise RuntimeError(f"commit {number} exists") from e
        finally:
            self._fs.delete(self._path(part), False)
