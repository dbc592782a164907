"""Session helpers: shared scratch tables and small plan-time decisions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and all executors are this machine, a temporary folder is made, kept for the life of the process.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder; a session that has ended is no error."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone
        pass


#: Scratch folders by the thing that needs them.
_kept: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new scratch folder in the shared folder, removed when the process ends or by ``release``."""
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    _kept.append(path)
    if len(_kept) == 1:
        atexit.register(release, spark)
    return path


def release(spark: SparkSession) -> int:
    """Removes all scratch folders made so far, for long sessions: results that still read them must have been written."""
    paths, _kept[:] = list(_kept), []
    for path in paths:
        remove(spark, path)
    return len(paths)


def materialize(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Number of hash ranges for operators that cut their key space themselves: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` reads, from the plan's file listings and without a job; None where a source gives no size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 2**60 else None


def hash_ranges(df: DataFrame, mb: int = 8) -> int:
    """Number of hash ranges that hold as many bytes as ``df`` reads: about ``mb`` megabytes each up to 10 000 ranges, then larger ones up
    to 8 times that; at least the session's shuffle width."""
    size = input_bytes(df) or 0
    return max(shuffle_width(df.sparkSession), min(-(-size // (mb << 20)), max(10_000, -(-size // (mb << 23)))))


def range_partitions(spark: SparkSession, ranges: int) -> int:
    """Partitions for a shuffle by range: one for each, as far as a shuffle bears; a task takes several ranges one after the other."""
    return min(ranges, max(20_000, shuffle_width(spark)))


def spread(df: DataFrame) -> DataFrame:
    """``df``, over more partitions if it has less than half as many as there are cores: a small table in one file would keep
    one core busy. Inputs of many blocks stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
