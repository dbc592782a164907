"""A Python data source that walks a folder: one row for each directory, file and symlink. The walk is cut into partitions at the folders
``split_depth`` levels below the root, so that one deep folder isn't one task; the levels above are rows of a partition of their own. Read with ``spark.read.format("lectern_walk").option("path", root)`` after ``register(spark)``.

Symlinks are rows but never followed; devices and pipes are left out; a folder that can't be read is a row with an error; excluded
folder names are pruned; below ``max_depth`` nothing is read and the folder's row says so in ``truncated``.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.functions.scalars import EXCLUDED_DIRS, ext, kind, mime, parent

SCHEMA = "rel_path string, name string, size long, mtime_ns long, ctime_ns long, inode long, is_dir boolean, is_symlink boolean, depth int, truncated boolean, error string"


class _Part(InputPartition):
    """Entries to walk, below the root; ``flat`` ones without what is below them."""

    def __init__(self, names: list[str], flat: bool = False):
        self.names, self.flat = names, flat


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.root = options["path"]
        self.depth = int(options.get("maxdepth", 32))
        given = options.get("exclude")
        self.split = max(1, int(options.get("splitdepth", 2)))
        self.exclude = set(given.split(",") if given is not None else EXCLUDED_DIRS)

    def partitions(self) -> list[InputPartition]:
        """The folders at ``split_depth``, found by listing the levels above them; a folder above is a row only."""
        above, level = [], [""]
        for _ in range(self.split):
            below = []
            for folder in level:
                try:
                    names = sorted(os.listdir(os.path.join(self.root, folder)))
                except OSError:
                    names = []
                for n in names:
                    rel = os.path.join(folder, n)
                    full = os.path.join(self.root, rel)
                    walk = os.path.isdir(full) and not os.path.islink(full) and n not in self.exclude
                    (below if walk and rel.count("/") + 1 < self.depth else above).append(rel)
            above += level[1:] if level == [""] else level
            level = below
        return [_Part([n for n in above if n], True), *(_Part([n]) for n in level)]

    def _row(self, path: str, st: os.stat_result, truncated: bool = False, error: str | None = None) -> tuple:
        rel = os.path.relpath(path, self.root)
        link = stat.S_ISLNK(st.st_mode)
        return (rel, os.path.basename(path), st.st_size, st.st_mtime_ns, st.st_ctime_ns, st.st_ino, stat.S_ISDIR(st.st_mode), link, rel.count("/") + 1, truncated, error)

    def read(self, partition: _Part) -> Iterator[tuple]:
        todo = [os.path.join(self.root, n) for n in reversed(partition.names)]
        while todo:
            path = todo.pop()
            try:
                st = os.lstat(path)
            except OSError:
                continue
            if stat.S_ISDIR(st.st_mode):
                if os.path.basename(path) in self.exclude:
                    continue
                deep = os.path.relpath(path, self.root).count("/") + 1 >= self.depth
                below, error = [], None
                if not deep:
                    try:  # a folder of the upper levels is listed too, for its error
                        below = sorted(os.listdir(path), reverse=True)
                    except OSError as e:
                        error = e.strerror
                yield self._row(path, st, deep, error)
                todo += [] if partition.flat else [os.path.join(path, n) for n in below]
            elif stat.S_ISREG(st.st_mode) or stat.S_ISLNK(st.st_mode):
                yield self._row(path, st)


class FolderWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderWalk)


def entries(spark: SparkSession, root: str, max_depth: int = 32, most: int | None = 300_000, exclude: list[str] | None = None) -> DataFrame:
    """The rows of a walk with what the catalogue adds: parent_rel, ext, kind, mime; folders have kind ``dir`` and size 0.

    A knowledge base takes ``most`` entries at most, those of least depth and then of least path; ``capped`` tells whether there are
    more. None takes all. Needs ``register(spark)``.
    """
    reader = spark.read.format("lectern_walk").option("path", root).option("maxDepth", max_depth)
    rows = (reader.option("exclude", ",".join(exclude)) if exclude is not None else reader).load()
    name, folder = F.col("name"), F.col("is_dir")
    none = F.lit("")
    rows = rows.withColumns({
        "parent_rel": parent(F.col("rel_path")), "ext": F.when(folder, none).otherwise(ext(name)), "kind": F.when(folder, "dir").otherwise(kind(name)),
        "mime": F.when(folder, "inode/directory").otherwise(mime(name)), "size": F.when(folder, F.lit(0).cast("long")).otherwise(F.col("size")),
    })
    if most is None:
        return rows.withColumn("capped", F.lit(False))
    more = rows.limit(most + 1).count() > most
    return (rows.orderBy("depth", "rel_path").limit(most) if more else rows).withColumn("capped", F.lit(more))


def list_folder(spark: SparkSession, path: str, limit: int = 2000, files: bool = True) -> DataFrame:
    """The entries of one folder as they are now, folders first, then by name; ``files`` or folders only; excluded names too."""
    rows = entries(spark, path, max_depth=1, most=None, exclude=[])
    rows = rows if files else rows.filter("is_dir")
    return rows.orderBy(F.desc("is_dir"), F.lower("name"), "name").limit(limit).select("name", "is_dir", "is_symlink", "size", "kind", "mtime_ns")
