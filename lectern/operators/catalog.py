"""Catalogue views: statistics, timelines, trees, breadcrumbs, counters, owners of paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.corpus import live

#: Kinds and their icons and viewers; a kind not listed has "file" and "unsupported".
ICONS = {"pdf": "fileText", "markdown": "fileText", "text": "fileText", "docx": "fileText", "html": "globe", "csv": "chart", "xlsx": "chart", "json": "type", "xml": "type", "yaml": "type", "pptx": "layers", "code": "terminal", "image": "image", "audio": "music", "video": "video", "other": "file"}
VIEWERS = {"csv": "sheet", "xlsx": "sheet", "docx": "doc", "pptx": "slides", "xml": "code", "yaml": "code", "code": "code", "pdf": "pdf", "markdown": "markdown", "html": "html", "text": "text", "json": "json", "image": "image", "audio": "audio", "video": "video"}
FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def lookup(c: Column, values: dict[str, str], default: str) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def seconds(ns: Column) -> Column:
    return F.timestamp_seconds(F.floor(ns / F.lit(1_000_000_000)))


def whole_seconds(ns: str) -> Column:
    """Timestamp of epoch nanoseconds, by integer division."""
    return F.timestamp_seconds(F.expr(f"{ns} div 1000000000"))


def by_kind(files: DataFrame, kb_id: int | None = None) -> DataFrame:
    """Live files by kind with their number, bytes and icon. A null size counts as 0, a null kind as its own group."""
    rows = files.filter(live())
    if kb_id is not None:
        rows = rows.filter(F.col("kb_id") == kb_id)
    out = rows.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return out.withColumn("icon", lookup(F.col("kind"), ICONS, "file")).withColumn("viewer", lookup(F.col("kind"), VIEWERS, "unsupported"))


def by_year(files: DataFrame, newest: int = 30) -> DataFrame:
    rows = files.filter(live() & F.col("mtime_ns").isNotNull())
    return rows.groupBy(F.year(whole_seconds("mtime_ns")).alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year")).limit(newest)


def timeline(files: DataFrame, bucket: str, newest: int = 200) -> DataFrame:
    """Live files by day, month or year of change in the session's time zone, newest first; an unknown bucket is by month."""
    rows = files.filter(live() & F.col("mtime_ns").isNotNull())
    key = F.date_format(whole_seconds("mtime_ns"), FORMATS.get(bucket, FORMATS["month"]))
    return rows.groupBy(key.alias("bucket")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).orderBy(F.desc("bucket")).limit(newest)


def text_states(files: DataFrame) -> DataFrame:
    return files.filter(live()).groupBy("text_state").agg(F.count("*").alias("n"), F.coalesce(F.sum("text_bytes"), F.lit(0)).alias("text_bytes"))


def counts(files: DataFrame, kbs: DataFrame) -> DataFrame:
    """All counters of the overview in one pass over the catalogue; directories count as directories only."""
    no = F.lit(False)
    gone, folder = F.coalesce("is_deleted", no), F.coalesce("is_dir", no)
    here = ~gone & ~folder
    state = lambda s: F.count_if(here & (F.coalesce("text_state", F.lit("")) == s))
    one = files.agg(
        F.count_if(here).alias("files"), F.count_if(~gone & folder).alias("folders"), F.count_if(gone).alias("deleted"),
        state("ok").alias("indexed"), state("pending").alias("pending"), state("failed").alias("failed"), state("unsupported").alias("unsupported"),
        F.coalesce(F.sum(F.when(here, F.col("size"))), F.lit(0)).alias("bytes"),
    )
    return one.join(F.broadcast(kbs.agg(F.count("*").alias("knowledge_bases"))))  # one row each


def kb_live_counts(files: DataFrame, kbs: DataFrame) -> DataFrame:
    """Every knowledge base with its live files and bytes, 0 where it has none, beside the stored totals."""
    own = files.filter(live()).groupBy("kb_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    out = kbs.select(F.col("id").alias("kb_id"), "name", "file_count", "total_bytes").join(own, "kb_id", "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})


def tree(files: DataFrame, favorites: DataFrame, kb_id: int, parent: str, sort: str = "name", limit: int = 500) -> DataFrame:
    """One level of a folder: folders first, then by name, time or size; the id decides ties."""
    rows = files.filter((F.col("kb_id") == kb_id) & (F.col("parent_rel") == parent) & ~F.coalesce("is_deleted", F.lit(False)))
    liked = favorites.filter("path is not null").select("path").distinct().withColumn("favorite", F.lit(True))
    folder = F.coalesce("is_dir", F.lit(False))
    rows = rows.join(liked, "path", "left").withColumns({"favorite": F.coalesce("favorite", F.lit(False)), "icon": F.when(folder, "folder").otherwise(lookup(F.col("kind"), ICONS, "file"))})
    low = F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = {"mtime": F.desc("mtime_ns"), "size": F.desc("size")}.get(sort, F.asc(low))
    return rows.orderBy(F.desc(folder), key, "file_id").limit(max(1, min(5000, limit))).select("file_id", "name", folder.alias("is_dir"), "kind", "icon", "favorite", "size")


def children(files: DataFrame, kb_id: int, parent: str, limit: int = 500) -> DataFrame:
    """One row: how many entries a folder has, and whether a page of ``limit`` leaves some out."""
    rows = files.filter((F.col("kb_id") == kb_id) & (F.col("parent_rel") == parent) & ~F.coalesce("is_deleted", F.lit(False)))
    return rows.agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > limit)


def breadcrumbs(files: DataFrame) -> DataFrame:
    """(file_id, level, rel_path, name) for each folder above each live file: the prefixes of its path, joined to the catalogue."""
    rows = files.filter(live() & (F.coalesce("parent_rel", F.lit("")) != "")).select("file_id", "kb_id", F.split("parent_rel", "/").alias("parts"))
    rows = rows.select("file_id", "kb_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("level"))
    rows = rows.select("file_id", "kb_id", "level", F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/").alias("rel_path"))
    folders = files.filter(F.coalesce("is_dir", F.lit(False)) & ~F.coalesce("is_deleted", F.lit(False))).groupBy("kb_id", "rel_path").agg(F.min("name").alias("name"))
    return rows.join(folders, ["kb_id", "rel_path"], "left").select("file_id", "level", "rel_path", "name")


def recently_updated(files: DataFrame, n: int = 12) -> DataFrame:
    return files.filter(live()).orderBy(F.desc("mtime_ns"), "file_id").limit(n).select("file_id", "name", "kind", "mtime_ns")


def owners(paths: DataFrame, kbs: DataFrame) -> DataFrame:
    """Each path with the knowledge base whose root holds it, the longest root first. The prefixes of a path are joined by
    equality, so that no pair of path and root is tried in vain."""
    roots = kbs.select(F.rtrim(F.col("root_path"), F.lit("/")).alias("root"), F.col("id").alias("kb_id"))
    parts = F.split("path", "/")
    each = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    best = each.filter("root <> ''").join(roots, "root").groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), F.col("root"), (-F.col("kb_id")).alias("k"))).alias("top"))
    return paths.join(best, "path", "left").select("path", (-F.col("top.k")).alias("owner"), F.col("top.root").alias("root"))


def overlaps(kbs: DataFrame) -> DataFrame:
    """Pairs of knowledge bases of which one root lies in the other."""
    own = kbs.select(F.col("id").alias("inner_id"), F.col("root_path").alias("path"))
    found = owners_all(own, kbs)
    return found.filter("inner_id <> outer_id").select("outer_id", "inner_id")


def owners_all(own: DataFrame, kbs: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    each = own.select("inner_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    return each.join(kbs.select(F.rtrim(F.col("root_path"), F.lit("/")).alias("root"), F.col("id").alias("outer_id")), "root")


#: Fields of a knowledge base that may be changed.
EDITABLE = ["name", "description", "icon_type", "icon_value", "accent", "cover", "background", "enabled"]


def kb_checks(wanted: DataFrame, kbs: DataFrame, allowed: list[str]) -> DataFrame:
    """(id, problem) of each knowledge base to be made (id, name, root_path): null if it may be. A name has 1 to 120 characters, the root lies
    below an allowed folder, and no root lies in another. Its own row in ``kbs`` doesn't count."""
    bare = lambda c: F.rtrim(F.col(c), F.lit("/"))
    new = wanted.select("id", "name", bare("root_path").alias("root"))
    inside = [(F.col("root") == a.rstrip("/")) | F.startswith("root", F.lit(a.rstrip("/") + "/")) for a in allowed]
    old = kbs.select(F.col("id").alias("other"), bare("root_path").alias("old_root")).filter("old_root is not null")
    above = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), F.lit(1), i), "/"))
    up = new.select("id", F.explode(above("root")).alias("old_root")).join(old, "old_root").select("id", "other")
    down = old.select("other", F.explode(above("old_root")).alias("root")).join(new, "root").select("id", "other")
    meets = up.union(down).filter("id <> other").groupBy("id").agg(F.min("other").alias("other"))
    name = F.length(F.trim(F.coalesce("name", F.lit(""))))
    ok = reduce(lambda a, b: a | b, inside, F.lit(False))
    problem = F.when((name < 1) | (name > 120), "name").when(~F.coalesce(ok, F.lit(False)), "root").when(F.col("other").isNotNull(), F.concat(F.lit("overlaps "), F.col("other").cast("string")))
    return new.join(meets, "id", "left").select("id", problem.alias("problem"))


def kb_update(kbs: DataFrame, changes: DataFrame) -> DataFrame:
    """Knowledge bases after changes (id, field, value as text, at): the latest of a field counts; other fields than ``EDITABLE`` are not
    changed, and unknown ids are ignored."""
    last = changes.filter(F.col("field").isin(EDITABLE)).groupBy("id", "field").agg(F.max(F.struct("at", "value")).alias("v"))
    given = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "v.value"))).alias("m"))  # at most one entry for each editable field
    out = kbs.join(given, "id", "left")
    return out.withColumns({c: F.coalesce(F.try_element_at("m", F.lit(c)).cast(kbs.schema[c].dataType), F.col(c)) for c in EDITABLE if c in kbs.columns}).drop("m")


def reasons(files: DataFrame) -> DataFrame:
    """Why a live file has no text."""
    note = F.when(F.col("text_state") == "ok", "").when(F.col("text_state") == "pending", "not indexed yet").when(F.col("text_state") == "empty", "no text inside").when(F.col("text_state") == "unsupported", F.coalesce("error", F.lit("format not supported"))).when(F.col("text_state") == "failed", F.coalesce("error", F.lit("extraction failed"))).otherwise("unknown")
    return files.filter(live()).groupBy("text_state", note.alias("note")).agg(F.count("*").alias("n"))
