"""Scan generations: identity-aware upsert, soft delete, resurrection, purge, replacement of dependent rows. Each operator takes
the old table and the new rows and gives the new table; writing is the caller's choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTITY = ["size", "mtime_ns", "inode"]
_KEEP = ["rel_path", "created_at", "image_w", "image_h", "unit_count", "text_bytes"]


def next_generation(files: DataFrame) -> DataFrame:
    return files.agg((F.coalesce(F.max("scan_gen"), F.lit(0)) + 1).alias("gen"))


def upsert(old: DataFrame, scan: DataFrame, key: tuple[str, ...] = ("kb_id", "path")) -> DataFrame:
    """The table after a scan, with column ``change``: new, changed, same, back (was deleted), unseen.

    Both sides have the same columns, unique by key. A seen row takes the scan's values, but keeps what was found out about it
    (relative path, creation, image size, counters); its text state goes back to pending and its error is cleared only if size,
    mtime_ns or inode differ (nulls equal nulls). An unseen row stays as it is.
    """
    keys = list(key)
    o, s = old.alias("o"), scan.alias("s")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"o.{k}") == F.col(f"s.{k}")
    both = o.join(s, on, "full")
    seen, known = F.col(f"s.{keys[-1]}").isNotNull(), F.col(f"o.{keys[-1]}").isNotNull()
    differs = F.lit(False)
    for c in IDENTITY:
        differs |= ~F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    cols = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"s.{c}")
        if c in _KEEP or c == "id":
            v = F.when(known, a).otherwise(b)
        elif c == "text_state":
            v = F.when(~seen, a).when(known & ~differs, a).otherwise(F.lit("pending"))
        elif c == "error":
            v = F.when(~seen, a).when(known & ~differs, a).otherwise(F.lit(None).cast("string"))
        elif c == "is_deleted":
            v = F.when(seen, F.lit(False)).otherwise(a)
        else:
            v = F.when(seen, b).otherwise(a)
        cols.append(v.alias(c))
    was = F.coalesce(F.col("o.is_deleted"), F.lit(False))
    change = F.when(~known, "new").when(~seen, "unseen").when(differs, "changed").when(was, "back").otherwise("same")
    return both.select(*cols, change.alias("change"))


def soft_delete(files: DataFrame, kb_id: int | None, gen: int) -> DataFrame:
    """Rows of a knowledge base (or of all) not seen in the generation become deleted; nothing else changes."""
    mine = F.lit(True) if kb_id is None else F.col("kb_id") == kb_id
    gone = mine & (F.coalesce("scan_gen", F.lit(-1)) < gen)
    return files.withColumn("is_deleted", F.when(gone, F.lit(True)).otherwise(F.col("is_deleted")))


def purge(files: DataFrame, kb_ids: DataFrame) -> DataFrame:
    """Without the rows of the given knowledge bases (column kb_id)."""
    return files.join(kb_ids.select("kb_id").distinct(), "kb_id", "left_anti")


def replace_units(units: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """All units of the files in ``new`` replaced."""
    return units.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def put_latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Upsert as a fold: the latest row of each key."""
    rest = [c for c in rows.columns if c not in (key, time)]
    top = F.max(F.struct(time, *rest)).alias("top")
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(top).select(key, *[F.col(f"top.{c}").alias(c) for c in [time, *rest]])
