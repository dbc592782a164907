"""Streaming forms of the library's folds: the same plans as in batch, on a growing folder of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.library import touches
from lectern.session import shared_dir


def events_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a folder or a file), with event time as timestamp."""
    schema = spark.read.parquet(path).schema
    glob = path[:-1] + f"[{path[-1]}]"  # a file is read as a pattern, a folder with all its files
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(glob)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(rows: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and give its result as a table. In update mode later versions of a row are in later
    batches; the column ``batch`` tells them apart. A repeated batch overwrites its own folder, so a restart repeats nothing."""
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/lectern/stream-{uuid.uuid4().hex}"

    def write(part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")


def recents(spark: SparkSession, path: str) -> DataFrame:
    """Touches of each user from a stream of view events: the last version of each row."""
    out = run_available(touches(events_stream(spark, path).filter("event_type = 'view'"), "user_id", "ts"), "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("open_count", "last_opened"), "batch").alias("v")).select("user_id", "v.open_count", "v.last_opened")


def tumbling(spark: SparkSession, path: str, width: str = "1 hour", late: str = "365 days") -> DataFrame:
    """Events by window and type. A window is written when the watermark, ``late`` behind the newest event, has passed its end;
    with a bounded folder the update mode gives all windows, the last version of each."""
    rows = events_stream(spark, path).filter("ts is not null").withWatermark("ts", late)
    out = run_available(rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")), "update")
    out = out.groupBy(F.col("w.start").alias("hour"), "event_type").agg(F.max_by("n", "batch").alias("n"))
    return out
