"""Processing only new or changed records (problem 3).

A *manifest* holds one row for each processed file: its identity (size, mtime_ns, ctime_ns, inode, and a checksum of the file where
the listing brings one as a further identity column; the catalogue has no file contents, so none is made up here) and the number of the
batch that wrote it. A run anti-joins the listing against the manifest, writes what is due under a batch id that follows from the work
itself, and only then commits.

* A crash before the commit leaves files that no commit names: the next run derives the same batch id from the same manifest and
  listing, overwrites them, and commits. So nothing is skipped or repeated.
* A commit is the appearance of one finished file ``commits/<number>``, which exists or not, and can be made once only: by a hard link
  on local disks and by a rename that refuses to overwrite elsewhere. Of two runs with one number the second fails. (On object stores
  without such a rename the folder ``commits`` has to lie on a file system that has it.)
* A batch writes its own rows only (a delta); every ``fanout`` deltas are merged into one. The commit names the parts of the manifest.

Nulls: an identity with a null never equals anything, so such a file is due on every run. Rows without a key are no files. Listing rows
repeat: of each key the greatest by ``order`` counts. An empty listing, or one in which nothing is due, commits nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.commits import CommitLog
from lectern.corpus import current_files, latest, live
from lectern.session import materialize

IDENTITY = ["size", "mtime_ns", "ctime_ns", "inode"]


def listing(files: DataFrame) -> DataFrame:
    """Live files of the catalogue: current row, no directory, no symlink, not deleted. Columns: file_id, identity."""
    now = current_files(files, [*IDENTITY, "is_dir", "is_symlink", "is_deleted"])
    keep = live() & ~F.coalesce(F.col("is_symlink"), F.lit(False))
    return now.filter(keep).select(F.col("id").alias("file_id"), *IDENTITY)


def manifest_from_log(index_log: DataFrame, jobs: DataFrame) -> DataFrame:
    """The manifest that a job log implies: for each file the done row of a completed job with the greatest job_id, then the
    greatest logged_at. Failed, canceled and unfinished jobs and late rows of older jobs leave it as it is."""
    done = index_log.filter((F.col("state") == "done") & F.col("file_id").isNotNull())
    completed = jobs.filter(F.col("state") == "completed").select(F.col("id").alias("job_id")).distinct()
    return latest(done.join(completed, "job_id", "left_semi"), "file_id", ["job_id", "logged_at"], IDENTITY)


def pending(listed: DataFrame, manifest: DataFrame, key: str = "file_id", identity: list[str] = IDENTITY) -> DataFrame:
    """Rows of the listing with no equal row in the manifest: one anti-join on the key and every column of the identity."""
    a, b = listed.alias("l"), manifest.select(key, *identity).alias("m")
    same = reduce(lambda x, y: x & y, [F.col(f"l.{c}") == F.col(f"m.{c}") for c in [key, *identity]])
    return a.join(b, same, "left_anti")


class IncrementalRun:
    """Batches of changed rows with exactly-once output in the folder ``root``.

    ``root/commits/<number>`` are the commits, ``root/manifest`` the parts that they name, ``root/out/batch=<batch>`` the outputs. Only
    what a commit names counts as written.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "file_id", identity: list[str] | None = None, order: list[str] | None = None, fanout: int = 8):
        self.spark, self.root, self.key, self.identity = spark, root.rstrip("/"), key, identity or IDENTITY
        self.order, self.fanout = order or [], fanout
        self._log = CommitLog(spark, f"{self.root}/commits")

    def commits(self) -> list[dict]:
        """The commits, oldest first: number, batch and parts of the manifest."""
        return self._log.entries()

    def _commit(self, number: int, batch: str, parts: list[str]) -> None:
        self._log.append(number, {"number": number, "batch": batch, "parts": parts})

    def manifest(self, like: DataFrame) -> DataFrame:
        """(key, identity, batch_no) of each file's last batch, or none of ``like``'s rows."""
        done = self.commits()
        if not done:
            return like.select(self.key, *self.identity).withColumn("batch_no", F.lit(0).cast("long")).limit(0)
        return self._newest(done[-1]["parts"])

    def _newest(self, parts: list[str]) -> DataFrame:
        return latest(self.spark.read.parquet(*[f"{self.root}/manifest/{p}" for p in parts]), self.key, ["batch_no"], [*self.identity, "batch_no"])

    def _add(self, rows: DataFrame, number: int, batch: str, parts: list[str]) -> None:
        rows.select(self.key, *self.identity).withColumn("batch_no", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.root}/manifest/{batch}")
        parts = [*parts, batch]
        if len(parts) > self.fanout:
            merged = f"merged-{batch}"
            self._newest(parts).write.mode("overwrite").parquet(f"{self.root}/manifest/{merged}")
            parts = [merged]
        self._commit(number, batch, parts)

    def adopt(self, manifest: DataFrame) -> None:
        """Commits what another system has processed (key, identity) as the first batch."""
        if self.commits():
            raise RuntimeError("only an empty folder can adopt a manifest")
        self._add(manifest, 1, "000000000001-adopted", [])

    def run(self, listed: DataFrame, process: Callable[[DataFrame], DataFrame], fail_after: str = "") -> str | None:
        """One batch: returns its id, or None if nothing is due. ``fail_after`` ("write", "manifest") breaks off there, for tests."""
        once = listed.filter(F.col(self.key).isNotNull())
        once = latest(once, self.key, [*self.order, *self.identity], self.identity)
        done = self.commits()
        number = len(done) + 1
        due = materialize(pending(once, self.manifest(once), self.key, self.identity), "due")
        stamp = due.select(F.count("*").alias("n"), F.bit_xor(F.xxhash64(self.key, *self.identity)).alias("x")).first()
        if not stamp["n"]:
            return None
        batch = f"{number:012d}-{stamp['n']}-{(stamp['x'] or 0) & (2**64 - 1):016x}"
        process(due).write.mode("overwrite").parquet(f"{self.root}/out/batch={batch}")
        if fail_after == "write":
            raise RuntimeError("stopped after the write")
        if fail_after == "manifest":
            self._commit = lambda *_: (_ for _ in ()).throw(RuntimeError("stopped before the commit"))
        self._add(due, number, batch, done[-1]["parts"] if done else [])
        return batch

    def output(self, batch: str | None = None) -> DataFrame | None:
        """The rows of one committed batch or of all, with their batch_no; what an unfinished run wrote is not among them."""
        done = [c for c in self.commits() if not c["batch"].endswith("-adopted") and batch in (None, c["batch"])]
        if not done:
            return None
        each = [self.spark.read.parquet(f"{self.root}/out/batch={c['batch']}").withColumn("batch_no", F.lit(c["number"])) for c in done]
        return reduce(lambda a, b: a.unionByName(b), each)
