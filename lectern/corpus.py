"""The library's tables: readers and the two views that most operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a catalogue row besides its id, in the order in which ties are broken.
_REST = (
    "kb_id parent_rel path rel_path name ext mime kind size mtime_ns ctime_ns inode is_dir is_symlink depth is_deleted "
    "text_state text_bytes unit_count image_w image_h error created_at"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row for each ``key``: the greatest by ``order`` (nulls first), then by ``keep``; equal rows count once.

    One aggregation with map-side combine, no window, so that a key with very many rows is no skew.
    """
    cols = [c for c in dict.fromkeys([*order, *keep]) if c != key]
    top = F.max(F.struct(*cols))
    return df.groupBy(key).agg(top.alias("_top")).select(key, *[F.col(f"_top.{c}").alias(c) for c in cols if c in keep])


def current_files(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The current row of each file: greatest scan_gen, then greatest updated_at. Rows without an id are no files."""
    keep = keep or [c for c in [*_REST, "scan_gen", "updated_at"] if c in files.columns]
    return latest(files.filter("id is not null"), "id", ["scan_gen", "updated_at"], keep)


def live(prefix: str = "") -> Column:
    """Neither directory nor deleted; a null flag counts as false."""
    no = F.lit(False)
    return ~F.coalesce(F.col(f"{prefix}is_dir"), no) & ~F.coalesce(F.col(f"{prefix}is_deleted"), no)


def texts(files: DataFrame, file_text: DataFrame, attrs: list[str]) -> DataFrame:
    """file_id, content, encoding and the given attributes that all rows of a file share (name, kind).

    Repeated rows of a file count once; files with no catalogue row or with null content have no text. The text is
    shuffled once, by file_id; the deduplication reuses that partitioning.
    """
    known = files.filter("id is not null").select(F.col("id").alias("file_id"), *attrs)
    known = known.groupBy("file_id").agg(*[F.max(a).alias(a) for a in attrs]) if attrs else known.distinct()
    own = file_text.filter("content is not null and file_id is not null").select("file_id", "content", "encoding")
    return own.join(known, "file_id").dropDuplicates(["file_id"])
