"""Queries over catalogue, library, jobs and scan generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.corpus import current_files, latest, table, texts
from lectern.operators import catalog as C
from lectern.operators import documents as D
from lectern.operators import library as L
from lectern.operators import snapshot as N
from lectern.streaming.library import recents, tumbling

_COLS = "kb_id parent_rel path rel_path name ext kind size mtime_ns inode is_dir is_deleted text_state text_bytes error scan_gen".split()


def files(spark: SparkSession, sf: str) -> DataFrame:
    return current_files(table(spark, sf, "files"), _COLS).withColumnRenamed("id", "file_id")


def _t(name: str):
    return lambda spark, sf: table(spark, sf, name)


def _on_files(fn, *names, **more):
    return lambda spark, sf: fn(files(spark, sf), *[table(spark, sf, n) for n in names], **more)


def _generation(spark: SparkSession, sf: str, newest: bool) -> DataFrame:
    """The catalogue before the last scan, or the rows of the last scan."""
    rows = table(spark, sf, "files").filter("id is not null")
    last = rows.agg(F.max("scan_gen")).first()[0]
    rows = rows.filter(F.col("scan_gen") == last if newest else F.col("scan_gen") < last)
    keep = [c for c in rows.columns if c not in ("id", "scan_gen", "updated_at")]
    return latest(rows, "id", ["scan_gen", "updated_at"], [*keep, "scan_gen"])


def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    out = N.upsert(_generation(spark, sf, False), _generation(spark, sf, True), ("kb_id", "id"))
    return out.select("id", "kb_id", "change", "text_state", "size", "is_deleted", "error")


def _soft(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf)
    gen = rows.agg(F.coalesce(F.max("scan_gen"), F.lit(0))).first()[0]
    return N.soft_delete(rows, 7, gen).groupBy("kb_id", "is_deleted").agg(F.count("*").alias("n"))


def _purge(spark: SparkSession, sf: str) -> DataFrame:
    off = table(spark, sf, "knowledge_bases").filter("not enabled").select(F.col("id").alias("kb_id"))
    return N.purge(files(spark, sf), off).groupBy("kb_id").agg(F.count("*").alias("n"))


def _put(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "file_text").select("file_id", "indexed_at", "chars", "lang", "source")
    return N.put_latest(rows, "file_id", "indexed_at")


def _owners(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "recents").filter("path is not null").select("path").distinct()
    return C.owners(paths, table(spark, sf, "knowledge_bases"))


def _toggle(spark: SparkSession, sf: str) -> DataFrame:
    return L.toggles(table(spark, sf, "events").filter("event_type = 'click'"), "user_id", "ts")


def _touch(spark: SparkSession, sf: str) -> DataFrame:
    return L.touches(table(spark, sf, "events").filter("event_type = 'view'"), "user_id", "ts")


def _log_page(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "index_log")
    job = log.agg(F.min("job_id")).first()[0]
    return L.log_page(log, job if job is not None else -1, 100).select("log_id", "file_id", "state")


def _tumbling(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").filter("ts is not null")
    return rows.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


_ICON_LOG = """(VALUES ('/a', 'builtin', 'star', 1), ('/a', 'emoji', '📁', 3), ('/b', NULL, 'book', 2), ('/c', 'builtin', 'pin', 1), ('/c', 'builtin', CAST(NULL AS STRING), 5), (NULL, 'builtin', 'x', 1)) AS t(path, icon_type, icon_value, at)"""
_KB_NEW = "(VALUES (9001, 'ok', '/volume9/new'), (9002, '', '/volume9/x'), (9003, 'deep', '{0}/sub'), (9004, 'far', '/etc'), (9005, 'top', '/volume1'), (9006, NULL, '/volume9/y')) AS t(id, name, root_path)"
_KB_EDITS = "(VALUES (1, 'name', 'Renamed', 2), (1, 'name', 'Earlier', 1), (1, 'root_path', '/elsewhere', 3), (2, 'enabled', 'false', 1), (99999, 'name', 'x', 1)) AS t(id, field, value, at)"


def _icons(spark: SparkSession, sf: str) -> DataFrame:
    """Icons of the top folders and files after a log of changes, one of which gives a real path an icon."""
    rows = files(spark, sf).filter("kb_id = 7 and parent_rel = ''").select("path", "kind", "is_dir")
    first = rows.agg(F.min("path").alias("path")).select("path", F.lit("emoji").alias("icon_type"), F.lit("⭐").alias("icon_value"), F.lit(9).alias("at"))
    log = spark.sql(f"SELECT * FROM {_ICON_LOG}")
    icons = L.set_icons(log.limit(0), log.unionByName(first))
    default = F.when(F.coalesce("is_dir", F.lit(False)), "folder").otherwise(C.lookup(F.col("kind"), C.ICONS, "file"))
    return L.icons_of(rows.select("path", "kind", "is_dir").unionByName(log.select("path").distinct().filter("path is not null").select("path", F.lit("text").alias("kind"), F.lit(False).alias("is_dir"))), icons, default).select("path", "icon_type", "icon")


def _kb_new(spark: SparkSession, sf: str) -> DataFrame:
    kbs = table(spark, sf, "knowledge_bases")
    root = kbs.agg(F.min("root_path")).first()[0]
    return C.kb_checks(spark.sql(f"SELECT * FROM {_KB_NEW.format(root)}"), kbs, ["/volume1", "/volume9/"])


def _kb_edit(spark: SparkSession, sf: str) -> DataFrame:
    edits = spark.sql(f"SELECT * FROM {_KB_EDITS}")
    return C.kb_update(table(spark, sf, "knowledge_bases"), edits).select("id", "name", "root_path", "enabled")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of all Markdown files, those of every second file replaced by one unit, in the order of an outline of two."""
    md = texts(table(spark, sf, "files"), table(spark, sf, "file_text"), ["kind"]).filter("kind = 'markdown'")
    units = D.sections(md).select("file_id", F.lit("section").alias("unit_type"), "unit_no", "label")
    new = md.filter("file_id % 2 = 0").select("file_id", F.lit("page").alias("unit_type"), F.lit(1).alias("unit_no"), F.lit("whole").alias("label"))
    return L.outline(N.replace_units(units, new), 2)


def _tally(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf).filter("text_state is not null and text_state <> 'pending'")
    return L.tally(rows.select(F.col("text_state").alias("state"), F.col("text_bytes").alias("chars")))


F_ = """f AS (SELECT id AS file_id, * EXCLUDE (id) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scan_gen DESC NULLS LAST,
  updated_at DESC NULLS LAST) AS rn FROM files WHERE id IS NOT NULL) WHERE rn = 1)"""
LIVE = "NOT coalesce(is_deleted, false) AND NOT coalesce(is_dir, false)"


def _case(values: dict[str, str], c: str, default: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"


_ICON, _VIEW = _case(C.ICONS, "kind", "file"), _case(C.VIEWERS, "kind", "unsupported")
_TS = "to_timestamp(mtime_ns // 1000000000) AT TIME ZONE 'UTC'"


def _sql_tree(key: str) -> str:
    return f"""WITH {F_} SELECT file_id, name, coalesce(is_dir, false) AS is_dir, kind, CASE WHEN coalesce(is_dir, false) THEN 'folder' ELSE {_ICON} END AS icon,
  coalesce(path IN (SELECT path FROM favorites WHERE path IS NOT NULL), false) AS favorite, size
FROM f WHERE kb_id = 7 AND parent_rel = '' AND NOT coalesce(is_deleted, false) ORDER BY coalesce(is_dir, false) DESC, {key}, file_id LIMIT 500"""


def _sql_time(fmt: str) -> str:
    return f"""WITH {F_} SELECT strftime({_TS}, '{fmt}') AS bucket, count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes
FROM f WHERE {LIVE} AND mtime_ns IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 200"""


def _sql_lib(name: str, time: str) -> str:
    return f"""WITH {F_}, l AS (SELECT path, {time}, name AS shown FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {time} DESC NULLS LAST, name DESC NULLS LAST) AS rn
  FROM {name} WHERE path IS NOT NULL) WHERE rn = 1),
o AS (SELECT * FROM (SELECT path, coalesce(is_deleted, false) AS gone, file_id, kind, row_number() OVER (PARTITION BY path ORDER BY coalesce(is_deleted, false), file_id) AS rn FROM f) WHERE rn = 1)
SELECT l.path, {time}, shown, file_id, kind, coalesce(gone, true) AS missing FROM l LEFT JOIN o ON o.path = l.path ORDER BY {time} DESC, l.path LIMIT 300"""


_GEN = """WITH g AS (SELECT max(scan_gen) AS g FROM files WHERE id IS NOT NULL),
o AS (SELECT * FROM (SELECT files.*, row_number() OVER (PARTITION BY id ORDER BY scan_gen DESC, updated_at DESC NULLS LAST) AS rn FROM files, g WHERE id IS NOT NULL AND scan_gen < g) WHERE rn = 1),
s AS (SELECT * FROM (SELECT files.*, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM files, g WHERE id IS NOT NULL AND scan_gen = g) WHERE rn = 1)"""
_DIFF = "(o.size IS DISTINCT FROM s.size OR o.mtime_ns IS DISTINCT FROM s.mtime_ns OR o.inode IS DISTINCT FROM s.inode)"

_REQUEUED = """SELECT id, attempts, CASE WHEN state NOT IN ('running', 'canceling', 'paused') THEN state WHEN coalesce(cancel_requested, false) THEN 'canceled' WHEN coalesce(attempts, 0) >= coalesce(max_attempts, 3) THEN 'failed' ELSE 'queued' END AS state,
  CASE WHEN state IN ('running', 'canceling', 'paused') AND NOT coalesce(cancel_requested, false) AND coalesce(attempts, 0) < coalesce(max_attempts, 3) THEN 0.0 ELSE progress END AS progress,
  CASE WHEN state IN ('running', 'canceling', 'paused') AND NOT coalesce(cancel_requested, false) AND coalesce(attempts, 0) < coalesce(max_attempts, 3) THEN false ELSE pause_requested END AS pause_requested,
  CASE WHEN state IN ('running', 'canceling', 'paused') AND NOT coalesce(cancel_requested, false) AND coalesce(attempts, 0) >= coalesce(max_attempts, 3) THEN 'interrupted too often' ELSE error END AS error FROM jobs"""
QUERIES = {
    "cat_by_kind": _on_files(C.by_kind),
    "cat_by_kind_kb": _on_files(C.by_kind, kb_id=7),
    "cat_by_year": _on_files(C.by_year),
    "cat_text_states": _on_files(C.text_states),
    "cat_reasons": _on_files(C.reasons),
    "cat_timeline_day": _on_files(C.timeline, bucket="day"),
    "cat_timeline_month": _on_files(C.timeline, bucket="other"),
    "cat_timeline_year": _on_files(C.timeline, bucket="year"),
    "cat_counts": _on_files(C.counts, "knowledge_bases"),
    "cat_kb_live_counts": _on_files(C.kb_live_counts, "knowledge_bases"),
    "cat_tree_name": _on_files(C.tree, "favorites", kb_id=7, parent=""),
    "cat_tree_mtime": _on_files(C.tree, "favorites", kb_id=7, parent="", sort="mtime"),
    "cat_tree_size": _on_files(C.tree, "favorites", kb_id=7, parent="", sort="size"),
    "cat_children": _on_files(C.children, kb_id=7, parent="", limit=5),
    "cat_kb_new": _kb_new,
    "cat_kb_edit": _kb_edit,
    "cat_breadcrumb": _on_files(C.breadcrumbs),
    "cat_recently_updated": _on_files(C.recently_updated),
    "cat_kb_of_path": _owners,
    "cat_root_overlap": lambda spark, sf: C.overlaps(table(spark, sf, "knowledge_bases")),
    "lib_favorites": lambda spark, sf: L.with_files(table(spark, sf, "favorites"), files(spark, sf), "added_at"),
    "lib_recents": lambda spark, sf: L.with_files(table(spark, sf, "recents"), files(spark, sf), "last_opened"),
    "lib_toggles": _toggle,
    "lib_touches": _touch,
    "snap_upsert": _upsert,
    "snap_soft_delete": _soft,
    "snap_purge": _purge,
    "snap_generation": lambda spark, sf: N.next_generation(table(spark, sf, "files")),
    "snap_put_text": _put,
    "job_counts": lambda spark, sf: L.job_counts(table(spark, sf, "jobs")),
    "job_retention": lambda spark, sf: L.retention(table(spark, sf, "jobs"), 20),
    "job_list": lambda spark, sf: L.list_jobs(table(spark, sf, "jobs"), ["completed", "failed"], limit=10, offset=3).select("id", "state", "type"),
    "job_active": lambda spark, sf: L.list_jobs(table(spark, sf, "jobs"), active_only=True).select("id", "state", "type"),
    "job_requeue": lambda spark, sf: L.requeue(table(spark, sf, "jobs")).select("id", "state", "progress", "pause_requested", "error"),
    "job_claim": lambda spark, sf: L.claim(L.requeue(table(spark, sf, "jobs")), 3).select("id", "state", "attempts"),
    "job_tally": _tally,
    "lib_icons": _icons,
    "snap_pending": lambda spark, sf: L.pending(files(spark, sf)),
    "snap_pending_kb": lambda spark, sf: L.pending(files(spark, sf), kb_id=7, force=True, limit=25),
    "snap_units": _units,
    "job_rows": lambda spark, sf: L.job_rows(table(spark, sf, "jobs")),
    "job_log_cursor": _log_page,
    "job_outcomes": lambda spark, sf: L.outcomes(table(spark, sf, "index_log")),
    "job_latest": lambda spark, sf: L.latest_per_file(table(spark, sf, "index_log")),
    "st_events_tumbling": _tumbling,
    "st_recents_stream": lambda spark, sf: recents(spark, f"{sf}/events.parquet").withColumn("last_opened", F.col("last_opened").cast("timestamp_ntz")),
    "st_windows_stream": lambda spark, sf: tumbling(spark, f"{sf}/events.parquet").withColumn("hour", F.col("hour").cast("timestamp_ntz")),
}
SQL = {
    "cat_by_kind": f"WITH {F_} SELECT kind, count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, {_ICON} AS icon, {_VIEW} AS viewer FROM f WHERE {LIVE} GROUP BY kind",
    "cat_by_kind_kb": f"WITH {F_} SELECT kind, count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, {_ICON} AS icon, {_VIEW} AS viewer FROM f WHERE {LIVE} AND kb_id = 7 GROUP BY kind",
    "cat_by_year": f"WITH {F_} SELECT CAST(year({_TS}) AS INT) AS year, count(*) AS n FROM f WHERE {LIVE} AND mtime_ns IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
    "cat_text_states": f"WITH {F_} SELECT text_state, count(*) AS n, CAST(coalesce(sum(text_bytes), 0) AS BIGINT) AS text_bytes FROM f WHERE {LIVE} GROUP BY 1",
    "cat_reasons": f"""WITH {F_} SELECT text_state, CASE text_state WHEN 'ok' THEN '' WHEN 'pending' THEN 'not indexed yet' WHEN 'empty' THEN 'no text inside'
  WHEN 'unsupported' THEN coalesce(error, 'format not supported') WHEN 'failed' THEN coalesce(error, 'extraction failed') ELSE 'unknown' END AS note, count(*) AS n FROM f WHERE {LIVE} GROUP BY 1, 2""",
    "cat_timeline_day": _sql_time("%Y-%m-%d"),
    "cat_timeline_month": _sql_time("%Y-%m"),
    "cat_timeline_year": _sql_time("%Y"),
    "cat_counts": f"""WITH {F_} SELECT count(*) FILTER ({LIVE}) AS files, count(*) FILTER (NOT coalesce(is_deleted, false) AND coalesce(is_dir, false)) AS folders,
  count(*) FILTER (coalesce(is_deleted, false)) AS deleted, count(*) FILTER ({LIVE} AND text_state = 'ok') AS indexed, count(*) FILTER ({LIVE} AND text_state = 'pending') AS pending,
  count(*) FILTER ({LIVE} AND text_state = 'failed') AS failed, count(*) FILTER ({LIVE} AND text_state = 'unsupported') AS unsupported,
  CAST(coalesce(sum(size) FILTER ({LIVE}), 0) AS BIGINT) AS bytes, (SELECT count(*) FROM knowledge_bases) AS knowledge_bases FROM f""",
    "cat_kb_live_counts": f"""WITH {F_}, o AS (SELECT kb_id, count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM f WHERE {LIVE} GROUP BY 1)
SELECT k.id AS kb_id, k.name, file_count, total_bytes, coalesce(n, 0) AS n, coalesce(bytes, 0) AS bytes FROM knowledge_bases k LEFT JOIN o ON o.kb_id = k.id""",
    "cat_tree_name": _sql_tree("translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
    "cat_tree_mtime": _sql_tree("mtime_ns DESC NULLS LAST"),
    "cat_tree_size": _sql_tree("size DESC NULLS LAST"),
    "cat_children": f"WITH {F_} SELECT count(*) AS total, count(*) > 5 AS has_more FROM f WHERE kb_id = 7 AND parent_rel = '' AND NOT coalesce(is_deleted, false)",
    "cat_kb_new": """WITH k AS (SELECT id, rtrim(root_path, '/') AS root FROM knowledge_bases), r AS (SELECT min(root_path) AS m FROM knowledge_bases)
SELECT 9001 AS id, CASE WHEN (SELECT count(*) FROM k WHERE root = '/volume9/new') > 0 THEN 'overlaps' END AS problem UNION ALL SELECT 9002, 'name' UNION ALL
SELECT 9003, 'overlaps ' || min(k.id) FROM k, r WHERE r.m || '/sub' = k.root OR starts_with(r.m || '/sub', k.root || '/') OR starts_with(k.root, r.m || '/sub/') UNION ALL
SELECT 9004, 'root' UNION ALL SELECT 9005, 'overlaps ' || min(id) FROM k WHERE root = '/volume1' OR starts_with(root, '/volume1/') UNION ALL SELECT 9006, 'name'""",
    "cat_kb_edit": "SELECT id, CASE WHEN id = 1 THEN 'Renamed' ELSE name END AS name, root_path, CASE WHEN id = 2 THEN false ELSE enabled END AS enabled FROM knowledge_bases",
    "cat_breadcrumb": f"""WITH {F_}, p AS (SELECT file_id, kb_id, string_split(parent_rel, '/') AS parts FROM f WHERE {LIVE} AND coalesce(parent_rel, '') <> ''),
e AS (SELECT file_id, kb_id, parts, unnest(range(1, len(parts) + 1)) AS level FROM p), x AS (SELECT file_id, kb_id, CAST(level AS INT) AS level, array_to_string(parts[1:level], '/') AS rel_path FROM e),
d AS (SELECT kb_id, rel_path, min(name) AS name FROM f WHERE coalesce(is_dir, false) AND NOT coalesce(is_deleted, false) GROUP BY 1, 2)
SELECT file_id, level, x.rel_path, name FROM x LEFT JOIN d ON d.kb_id = x.kb_id AND d.rel_path = x.rel_path""",
    "cat_recently_updated": f"WITH {F_} SELECT file_id, name, kind, mtime_ns FROM f WHERE {LIVE} ORDER BY mtime_ns DESC NULLS LAST, file_id LIMIT 12",
    "cat_kb_of_path": """WITH p AS (SELECT DISTINCT path FROM recents WHERE path IS NOT NULL), k AS (SELECT id, rtrim(root_path, '/') AS root FROM knowledge_bases),
m AS (SELECT path, id AS owner, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC, root DESC, id) AS rn FROM p JOIN k ON root <> '' AND (path = root OR starts_with(path, root || '/')))
SELECT p.path, owner, root FROM p LEFT JOIN m ON m.path = p.path AND rn = 1""",
    "cat_root_overlap": """SELECT a.id AS outer_id, b.id AS inner_id FROM knowledge_bases a JOIN knowledge_bases b ON a.id <> b.id
  AND (b.root_path = rtrim(a.root_path, '/') OR starts_with(b.root_path, rtrim(a.root_path, '/') || '/'))""",
    "lib_favorites": _sql_lib("favorites", "added_at"),
    "lib_recents": _sql_lib("recents", "last_opened"),
    "lib_toggles": "SELECT user_id, count(*) AS toggles, max(ts) AS added_at FROM events WHERE event_type = 'click' AND user_id IS NOT NULL GROUP BY 1 HAVING count(*) % 2 = 1",
    "lib_touches": "SELECT user_id, count(*) AS open_count, max(ts) AS last_opened FROM events WHERE event_type = 'view' AND user_id IS NOT NULL GROUP BY 1",
    "snap_upsert": f"""{_GEN} SELECT coalesce(o.id, s.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.kb_id ELSE o.kb_id END AS kb_id,
  CASE WHEN o.id IS NULL THEN 'new' WHEN s.id IS NULL THEN 'unseen' WHEN {_DIFF} THEN 'changed' WHEN coalesce(o.is_deleted, false) THEN 'back' ELSE 'same' END AS change,
  CASE WHEN s.id IS NULL THEN o.text_state WHEN o.id IS NOT NULL AND NOT {_DIFF} THEN o.text_state ELSE 'pending' END AS text_state,
  CASE WHEN s.id IS NOT NULL THEN s.size ELSE o.size END AS size, CASE WHEN s.id IS NOT NULL THEN false ELSE o.is_deleted END AS is_deleted,
  CASE WHEN s.id IS NULL THEN o.error WHEN o.id IS NOT NULL AND NOT {_DIFF} THEN o.error END AS error
FROM o FULL JOIN s ON o.id = s.id AND o.kb_id = s.kb_id""",
    "snap_soft_delete": f"""WITH {F_}, g AS (SELECT coalesce(max(scan_gen), 0) AS g FROM f) SELECT kb_id,
  CASE WHEN kb_id = 7 AND coalesce(scan_gen, -1) < g THEN true ELSE is_deleted END AS is_deleted, count(*) AS n FROM f, g GROUP BY 1, 2""",
    "snap_purge": f"WITH {F_} SELECT kb_id, count(*) AS n FROM f WHERE kb_id IS NULL OR kb_id NOT IN (SELECT id FROM knowledge_bases WHERE NOT enabled) GROUP BY 1",
    "snap_generation": "SELECT coalesce(max(scan_gen), 0) + 1 AS gen FROM files",
    "snap_put_text": """SELECT file_id, indexed_at, chars, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST, chars DESC NULLS LAST,
  lang DESC NULLS LAST, source DESC NULLS LAST) AS rn FROM file_text WHERE file_id IS NOT NULL) WHERE rn = 1""",
    "job_counts": f"SELECT s.state, count(j.id) AS n FROM (SELECT unnest({L.STATES}) AS state) s LEFT JOIN jobs j ON j.state = s.state GROUP BY 1",
    "job_retention": "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS rn FROM jobs WHERE state IN ('completed', 'failed', 'canceled')) WHERE rn > 20",
    "job_list": "SELECT id, state, type FROM jobs WHERE state IN ('completed', 'failed') ORDER BY id DESC LIMIT 10 OFFSET 3",
    "job_active": "SELECT id, state, type FROM jobs WHERE state IN ('queued', 'running', 'paused', 'canceling') ORDER BY id DESC LIMIT 50",
    "job_requeue": f"SELECT id, state, progress, pause_requested, error FROM ({_REQUEUED})",
    "job_claim": f"""WITH q AS ({_REQUEUED}), t AS (SELECT id FROM q WHERE state = 'queued' AND NOT coalesce(pause_requested, false) ORDER BY id LIMIT (SELECT greatest(0, 3 - count(*)) FROM q WHERE state = 'running'))
SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'running' ELSE state END AS state, coalesce(attempts, 0) + CASE WHEN id IN (SELECT id FROM t) THEN 1 ELSE 0 END AS attempts FROM q""",
    "job_tally": f"""WITH {F_} SELECT count(*) AS total, count(*) FILTER (text_state = 'ok') AS indexed, count(*) FILTER (text_state = 'empty') AS empty, count(*) FILTER (text_state = 'unsupported') AS unsupported,
  count(*) FILTER (text_state NOT IN ('ok', 'empty', 'unsupported')) AS failed, CAST(coalesce(sum(text_bytes), 0) AS BIGINT) AS chars FROM f WHERE text_state IS NOT NULL AND text_state <> 'pending'""",
    "lib_icons": f"""WITH {F_}, r AS (SELECT path, kind, is_dir FROM f WHERE kb_id = 7 AND parent_rel = '')
SELECT path, CASE WHEN path = (SELECT min(path) FROM r) THEN 'emoji' ELSE 'builtin' END AS icon_type, CASE WHEN path = (SELECT min(path) FROM r) THEN '⭐' WHEN coalesce(is_dir, false) THEN 'folder' ELSE {_ICON} END AS icon FROM r
UNION ALL SELECT * FROM (VALUES ('/a', 'emoji', '📁'), ('/b', 'builtin', 'book'), ('/c', 'builtin', 'fileText')) AS t(path, icon_type, icon)""",
    "snap_pending": f"WITH {F_} SELECT kb_id, file_id, rel_path, kind FROM f WHERE {LIVE} AND text_state = 'pending'",
    "snap_pending_kb": f"WITH {F_} SELECT kb_id, file_id, rel_path, kind FROM f WHERE {LIVE} AND kb_id = 7 ORDER BY kb_id, file_id LIMIT 25",
    "snap_units": """WITH t AS (SELECT DISTINCT t.file_id, content FROM file_text t JOIN (SELECT DISTINCT id, kind FROM files) f ON f.id = t.file_id WHERE content IS NOT NULL AND kind = 'markdown'),
e AS (SELECT file_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM (SELECT file_id, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS a FROM t WHERE file_id % 2 = 1)),
h AS (SELECT file_id, 'section' AS unit_type, CAST(row_number() OVER (PARTITION BY file_id ORDER BY i) AS INT) AS unit_no, regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*#*\\s*$', 2) AS label FROM e WHERE regexp_matches(line, '^(#{1,6})\\s+(.+?)\\s*#*\\s*$'))
SELECT *, unit_no AS place FROM h WHERE unit_no <= 2 UNION ALL SELECT file_id, 'page', 1, 'whole', 1 FROM t WHERE file_id % 2 = 0""",
    "job_rows": """SELECT id, type, state, CAST(json_extract_string(params, '$.kb_id') AS VARCHAR) AS kb, round(greatest(0.0, least(100.0, coalesce(progress, 0.0) * 100)), 3) AS percent,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, state IN ('queued', 'running', 'paused') AS active, coalesce(attempts, 0) < coalesce(max_attempts, 0) AS may_retry FROM jobs""",
    "job_log_cursor": "SELECT DISTINCT log_id, file_id, state FROM index_log WHERE job_id = (SELECT min(job_id) FROM index_log) AND log_id > 100 ORDER BY log_id LIMIT 500",
    "job_outcomes": "SELECT job_id, state, count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT log_id, job_id, state, size FROM index_log) GROUP BY 1, 2",
    "job_latest": """SELECT file_id, job_id, state FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY job_id DESC, logged_at DESC NULLS LAST, log_id DESC, state DESC) AS rn
  FROM index_log WHERE file_id IS NOT NULL) WHERE rn = 1""",
    "st_recents_stream": "SELECT user_id, count(*) AS open_count, max(ts) AS last_opened FROM events WHERE event_type = 'view' AND user_id IS NOT NULL GROUP BY 1",
    "st_windows_stream": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "st_events_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
