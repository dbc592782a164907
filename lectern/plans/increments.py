"""Queries of problem 3: what the next index job must process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.corpus import table
from lectern.operators.incremental import IDENTITY, IncrementalRun, listing, manifest_from_log
from lectern.session import scratch

OLD_SCAN = 35  # the scan after which the first batch of p3_batches runs


def found(spark: SparkSession, sf: str) -> DataFrame:
    """Live files whose identity is not the one last handled with success: the batch that a run writes and commits after it has
    adopted the manifest that the index log implies."""
    run = IncrementalRun(spark, scratch(spark, "increments"))
    run.adopt(manifest_from_log(table(spark, sf, "index_log"), table(spark, sf, "jobs")))
    files = table(spark, sf, "files")
    batch = run.run(listing(files), lambda due: due.select("file_id"))
    return run.output(batch).select("file_id") if batch else files.select(F.col("id").alias("file_id")).limit(0)


def batches(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, after an older scan and after the last, each of which breaks off once and runs again: what they committed."""
    run = IncrementalRun(spark, scratch(spark, "increments"))
    files = table(spark, sf, "files")
    for seen, crash in ((files.filter(F.col("scan_gen") <= OLD_SCAN), "write"), (files, "manifest")):
        listed = listing(seen)
        try:
            IncrementalRun(spark, run.root).run(listed, lambda due: due.select("file_id"), fail_after=crash)
        except RuntimeError:
            pass
        run.run(listed, lambda due: due.select("file_id"))
    out = run.output()
    return out.select("batch_no", "file_id") if out is not None else files.select(F.lit(1).cast("long").alias("batch_no"), F.col("id").alias("file_id")).limit(0)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest itself."""
    return manifest_from_log(table(spark, sf, "index_log"), table(spark, sf, "jobs"))


def states(spark: SparkSession, sf: str) -> DataFrame:
    """How many live files are new, changed or unchanged."""
    now = listing(table(spark, sf, "files"))
    old = manifest(spark, sf).select("file_id", *[F.col(c).alias(f"m_{c}") for c in IDENTITY], F.lit(True).alias("seen"))
    same = F.lit(True)
    for c in IDENTITY:
        same &= F.col(c) == F.col(f"m_{c}")
    state = F.when(F.col("seen").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return now.join(old, "file_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))




def _listed(name: str, where: str = "true") -> str:
    return f"""{name} AS (SELECT id AS file_id, size, mtime_ns, ctime_ns, inode FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY scan_gen DESC NULLS LAST, updated_at DESC NULLS LAST) AS rn FROM files WHERE id IS NOT NULL AND {where})
  WHERE rn = 1 AND NOT coalesce(is_dir, false) AND NOT coalesce(is_symlink, false) AND NOT coalesce(is_deleted, false))"""


_LISTED = _listed("listed")
_MANIFEST = """manifest AS (
  SELECT file_id, size, mtime_ns, ctime_ns, inode FROM (
    SELECT l.*, row_number() OVER (PARTITION BY file_id ORDER BY job_id DESC, logged_at DESC NULLS LAST, size DESC NULLS LAST,
      mtime_ns DESC NULLS LAST, ctime_ns DESC NULLS LAST, inode DESC NULLS LAST) AS rn
    FROM index_log l WHERE state = 'done' AND file_id IS NOT NULL AND job_id IN (SELECT id FROM jobs WHERE state = 'completed'))
  WHERE rn = 1)"""

QUERIES = {"p3_found": found, "p3_batches": batches, "p3_manifest": manifest, "p3_states": states}
SQL = {
    "p3_found": f"""WITH {_LISTED}, {_MANIFEST}
SELECT file_id FROM listed a WHERE NOT EXISTS (
  SELECT 1 FROM manifest m WHERE m.file_id = a.file_id AND m.size = a.size AND m.mtime_ns = a.mtime_ns
    AND m.ctime_ns = a.ctime_ns AND m.inode = a.inode)""",
    "p3_batches": f"""WITH {_listed("old", f"scan_gen <= {OLD_SCAN}")}, {_LISTED}
SELECT CAST(1 AS BIGINT) AS batch_no, file_id FROM old UNION ALL
SELECT CASE WHEN EXISTS (SELECT 1 FROM old) THEN 2 ELSE 1 END, file_id FROM listed a WHERE NOT EXISTS (
  SELECT 1 FROM old m WHERE m.file_id = a.file_id AND m.size = a.size AND m.mtime_ns = a.mtime_ns AND m.ctime_ns = a.ctime_ns AND m.inode = a.inode)""",
    "p3_manifest": f"WITH {_MANIFEST} SELECT * FROM manifest",
    "p3_states": f"""WITH {_LISTED}, {_MANIFEST}
SELECT CASE WHEN m.file_id IS NULL THEN 'new' WHEN m.size = a.size AND m.mtime_ns = a.mtime_ns AND m.ctime_ns = a.ctime_ns
  AND m.inode = a.inode THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n
FROM listed a LEFT JOIN manifest m USING (file_id) GROUP BY 1""",
}
