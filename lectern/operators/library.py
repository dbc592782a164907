"""Favourites, recents, knowledge-base edits and the job log, as folds over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.corpus import live

STATES = ["queued", "running", "paused", "completed", "failed", "canceled", "interrupted"]


def with_files(rows: DataFrame, files: DataFrame, time: str, n: int = 300) -> DataFrame:
    """Favourites or recents with their catalogue row, by path only, newest first. ``missing``: deleted or not in the catalogue.
    Repeated paths count once: the latest."""
    last = rows.filter("path is not null").groupBy("path").agg(F.max(F.struct(time, "name")).alias("top")).select("path", f"top.{time}", F.col("top.name").alias("shown"))
    own = files.groupBy("path").agg(F.min(F.struct(F.coalesce("is_deleted", F.lit(False)).alias("gone"), F.col("file_id"), F.col("kind"))).alias("f"))
    out = last.join(own, "path", "left")
    return out.select("path", time, "shown", F.col("f.file_id").alias("file_id"), F.col("f.kind").alias("kind"), F.coalesce("f.gone", F.lit(True)).alias("missing")).orderBy(F.desc(time), "path").limit(n)


def toggles(events: DataFrame, key: str, time: str) -> DataFrame:
    """State after a log of toggles: the keys toggled an odd number of times, with their last time."""
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("toggles"), F.max(time).alias("added_at")).filter("toggles % 2 = 1")


def touches(events: DataFrame, key: str, time: str) -> DataFrame:
    """Recents after a log of touches: number and last time. The same plan runs on a stream in update mode."""
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("open_count"), F.max(time).alias("last_opened"))


def job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by state; the seven states are always there."""
    all_states = jobs.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return all_states.join(jobs.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def retention(jobs: DataFrame, keep: int) -> DataFrame:
    """Ended jobs beyond the newest ``keep``."""
    ended = jobs.filter(F.col("state").isin("completed", "failed", "canceled"))
    newest = ended.orderBy(F.desc("id")).limit(keep).select("id")
    return ended.join(newest, "id", "left_anti").select("id")


def job_rows(jobs: DataFrame) -> DataFrame:
    """Jobs as shown: parsed parameters, clamped percent, formatted times, whether still active."""
    percent = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("progress", F.lit(0.0)) * 100))
    return jobs.select(
        "id", "type", "state", F.get_json_object("params", "$.kb_id").alias("kb"), F.round(percent, 3).alias("percent"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.col("state").isin("queued", "running", "paused").alias("active"),
        (F.coalesce("attempts", F.lit(0)) < F.coalesce("max_attempts", F.lit(0))).alias("may_retry"),
    )


def log_page(log: DataFrame, job_id: int, after: int, n: int = 500) -> DataFrame:
    """Rows of a log after a cursor."""
    return log.filter((F.col("job_id") == job_id) & (F.col("log_id") > after)).dropDuplicates(["log_id"]).orderBy("log_id").limit(n)


def outcomes(log: DataFrame) -> DataFrame:
    """Number and bytes by job and state of handling; exact repeats of a log row count once."""
    return log.dropDuplicates(["log_id"]).groupBy("job_id", "state").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def list_jobs(jobs: DataFrame, states: list[str] | None = None, type_: str | None = None, active_only: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of jobs, newest first, by state, type, or only those that may still change."""
    rows = jobs.filter("id is not null")
    if states:
        rows = rows.filter(F.col("state").isin(states))
    if type_:
        rows = rows.filter(F.col("type") == type_)
    if active_only:
        rows = rows.filter(F.col("state").isin("queued", "running", "paused", "canceling"))
    return rows.orderBy(F.desc("id")).offset(offset).limit(limit)


def requeue(jobs: DataFrame) -> DataFrame:
    """The queue after a crash: jobs that were running, paused or being canceled are canceled if that was asked for, failed if their attempts
    are used up (null counts as none, a null bound as 3), else queued from the start."""
    broken = F.col("state").isin("running", "canceling", "paused")
    no, spent = F.lit(False), F.coalesce("attempts", F.lit(0)) >= F.coalesce("max_attempts", F.lit(3))
    state = F.when(~broken, F.col("state")).when(F.coalesce("cancel_requested", no), "canceled").when(spent, "failed").otherwise("queued")
    again = F.coalesce(broken & (state == "queued"), no)
    return jobs.withColumns({
        "state": state, "progress": F.when(again, 0.0).otherwise(F.col("progress")), "pause_requested": F.when(again, no).otherwise(F.col("pause_requested")),
        "error": F.when(broken & (state == "failed"), "interrupted too often").otherwise(F.col("error")),
    })


def claim(jobs: DataFrame, workers: int = 2) -> DataFrame:
    """The queue after the free workers took the oldest queued jobs; a job taken counts one attempt more. The free ones are those that no
    running job has."""
    busy = jobs.agg(F.count_if(F.col("state") == "running").alias("busy"))
    oldest = jobs.filter((F.col("state") == "queued") & ~F.coalesce("pause_requested", F.lit(False))).orderBy("id").limit(workers).select("id")
    oldest = oldest.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("id"))).join(F.broadcast(busy))  # at most as many rows as workers
    taken = oldest.filter(F.col("place") <= workers - F.col("busy")).select("id", F.lit(True).alias("taken"))
    out = jobs.join(F.broadcast(taken), "id", "left")
    return out.withColumns({"state": F.when(F.col("taken"), "running").otherwise(F.col("state")), "attempts": F.coalesce("attempts", F.lit(0)) + F.when(F.col("taken"), 1).otherwise(0)}).drop("taken")


def pending(files: DataFrame, kb_id: int | None = None, force: bool = False, limit: int | None = None) -> DataFrame:
    """Live files that an index run takes, in its order: those waiting for it, or all with ``force``."""
    rows = files.filter(live())
    if kb_id is not None:
        rows = rows.filter(F.col("kb_id") == kb_id)
    if not force:
        rows = rows.filter(F.col("text_state") == "pending")
    rows = rows.select("kb_id", "file_id", "rel_path", "kind")
    return rows.orderBy("kb_id", "file_id").limit(limit) if limit else rows


def tally(handled: DataFrame) -> DataFrame:
    """The result of an index run from its files (state, chars): one row; a state that is none of the four counts as failed."""
    state = F.when(F.col("state").isin("ok", "empty", "unsupported"), F.col("state")).otherwise("failed")
    each = [F.count_if(state == s).alias("indexed" if s == "ok" else s) for s in ("ok", "empty", "unsupported", "failed")]
    return handled.agg(F.count("*").alias("total"), *each, F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


def set_icons(icons: DataFrame, changes: DataFrame) -> DataFrame:
    """Custom icons (path, icon_type, icon_value, at) after changes of the same columns: the latest of a path counts, and one without a value
    removes the icon. Rows without a path are none."""
    both = icons.select("path", "icon_type", "icon_value", "at").unionByName(changes.select("path", "icon_type", "icon_value", "at")).filter("path is not null")
    last = both.groupBy("path").agg(F.max(F.struct("at", "icon_type", "icon_value")).alias("v"))
    return last.filter("v.icon_value is not null").select("path", F.coalesce("v.icon_type", F.lit("builtin")).alias("icon_type"), "v.icon_value", "v.at")


def icons_of(rows: DataFrame, icons: DataFrame, default: Column) -> DataFrame:
    """``rows`` (with a path) and their icon: the custom one of the path, else the default."""
    own = icons.groupBy("path").agg(F.max(F.struct("at", "icon_type", "icon_value")).alias("v"))
    out = rows.join(own, "path", "left")
    return out.withColumns({"icon_type": F.coalesce("v.icon_type", F.lit("builtin")), "icon": F.coalesce("v.icon_value", default)}).drop("v")


def latest_per_file(log: DataFrame) -> DataFrame:
    """The last handling of each file, whatever its state."""
    top = F.max(F.struct("job_id", "logged_at", "log_id", "state")).alias("top")
    return log.filter("file_id is not null").groupBy("file_id").agg(top).select("file_id", "top.job_id", "top.state")


def outline(units: DataFrame, limit: int = 500) -> DataFrame:
    """The units of each file by type and number, ``limit`` at most for each."""
    w = W.partitionBy("file_id").orderBy("unit_type", "unit_no")
    return units.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
