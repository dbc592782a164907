"""Search queries over the whole library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.corpus import current_files, latest, table
from lectern.functions.text import MARKED, PLAIN, highlight
from lectern.operators import search as S
from lectern.session import spread

AS_OF = 1767225600.0
_COLS = "kb_id parent_rel path rel_path name ext kind size mtime_ns is_dir is_deleted".split()
#: Indexes kept for the life of an application, by its id and the data folder.
_KEPT: dict[tuple[str, str], S.TextIndex] = {}


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return current_files(table(spark, sf, "files"), _COLS).withColumnRenamed("id", "file_id")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """The text rows; the search takes the last indexed row of each file."""
    return spread(table(spark, sf, "file_text").select("file_id", "indexed_at", "name", "path", "content"))


def _last_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One text row for each file: the last indexed."""
    return latest(_texts(spark, sf).filter("file_id is not null"), "file_id", ["indexed_at"], ["name", "path", "content"])


def _favorites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "favorites")


def _index(spark: SparkSession, sf: str) -> S.TextIndex:
    """The kept index of a library: the first query makes it, later ones read it."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _KEPT:
        _KEPT[at] = S.TextIndex.build(_last_texts(spark, sf))
    return _KEPT[at]


def _search(q: str, **more):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return S.search(_files(spark, sf), _index(spark, sf), _favorites(spark, sf), q, AS_OF, **more)

    return run


def _bm25(q: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _index(spark, sf).bm25(S.compile_query(q)).select("file_id", F.round("bm25", 6).alias("bm25"))

    return run


def _bm25_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a scan of all texts, without an index."""
    return S.bm25(_texts(spark, sf), S.compile_query("backup archiv")).select("file_id", F.round("bm25", 6).alias("bm25"))


def _index_changes(spark: SparkSession, sf: str) -> DataFrame:
    """An index whose texts were others first, then changed, some removed, then compacted: only the last state counts."""
    texts = _last_texts(spark, sf)
    index = S.TextIndex(spark)
    index.add(texts.filter("file_id % 3 <> 0").withColumn("content", F.lit("backup archive backup")))
    index.add(texts)
    index.remove(texts.filter("file_id % 5 = 0"))
    index.compact()
    return index.bm25(S.compile_query("backup archiv")).select("file_id", F.round("bm25", 6).alias("bm25"))


def _envelope(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for q, index in (("backup archive", True), ("打印机 backup", True), ("索引", True), ("backup", False)):
        hits = S.search(_files(spark, sf), _index(spark, sf), _favorites(spark, sf), q, AS_OF, offset=-5, limit=500, has_index=index)
        parts.append(S.envelope(hits, q, -5, 500, index))
    return reduce(lambda a, b: a.union(b), parts).withColumn("terms", F.array_join("terms", "~"))


def _grams(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).grams(["打印机", "索引、"])


def _likes(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf).filter(S.Filters().column())
    return S.likes(files, _texts(spark, sf), "DRAFT.").select("file_id")


def _merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.candidates(_files(spark, sf), _texts(spark, sf), "打印机 backup", S.Filters())
    return rows.select("file_id", "source", "base")


def _recent(spark: SparkSession, sf: str) -> DataFrame:
    return S.suggest(_files(spark, sf), " ", recents=table(spark, sf, "recents"))


def _suggest(spark: SparkSession, sf: str) -> DataFrame:
    return S.suggest(_files(spark, sf), "Dra")


def _related(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    first = files.filter(S.Filters().column()).agg(F.min("file_id")).first()[0]
    return S.related(files, first if first is not None else -1)


def _df(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and occurrences of every term."""
    rows = S.postings(_last_texts(spark, sf))
    return rows.groupBy("term").agg(F.countDistinct("file_id").alias("df"), F.sum("tf").alias("n"))


def _highlight(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select("name").distinct().select("name", highlight(F.col("name"), ["dra", "a"]).alias("marked"))


# --- SQL ---
_FILES = """f AS (SELECT id AS file_id, * EXCLUDE (id) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scan_gen DESC NULLS LAST,
  updated_at DESC NULLS LAST) AS rn FROM files WHERE id IS NOT NULL) WHERE rn = 1)"""
_TEXTS = """t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST, name DESC NULLS LAST,
  path DESC NULLS LAST, content DESC NULLS LAST) AS rn FROM file_text WHERE file_id IS NOT NULL) WHERE rn = 1)"""
_LIVE = "NOT coalesce(is_deleted, false) AND NOT coalesce(is_dir, false)"


def _sql_fold(c: str) -> str:
    return f"translate(lower({c}), '{MARKED}', '{PLAIN}')"


def _sql_pad(c: str) -> str:
    body = f"trim(regexp_replace({_sql_fold(f'coalesce({c}, {chr(39) * 2})')}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'))"
    return f"CASE WHEN {body} = '' THEN '' ELSE ' ' || {body} || ' ' END"


def _sql_occ(c: str, needle: str) -> str:
    return f"((length({c}) - length(replace({c}, '{needle}', ''))) // {len(needle)})"


def _sql_bm25(q: str) -> str:
    """CTEs p, c, s, b: b(file_id, bm25)."""
    ps = S.compile_query(q)
    f = [f"10.0 * {_sql_occ('n', p.needle)} + 4.0 * {_sql_occ('h', p.needle)} + 1.0 * {_sql_occ('x', p.needle)} AS f{i}" for i, p in enumerate(ps)]
    length = " + ".join(f"CASE WHEN {c} = '' THEN 0 ELSE {_sql_occ(c, '  ')} + 1 END" for c in "nhx")
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(ps)))
    idf = [f"CASE WHEN ln((s.n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((s.n - d{i} + 0.5) / (d{i} + 0.5)) END" for i in range(len(ps))]
    total = " + ".join(f"({idf[i]}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(ps)))
    return f"""{_TEXTS}, p AS (SELECT file_id, {_sql_pad('name')} AS n, {_sql_pad('path')} AS h, {_sql_pad('content')} AS x FROM t),
c AS (SELECT file_id, {length} AS len, {', '.join(f)} FROM p), s AS (SELECT count(*) AS n, avg(len) AS mean, {d} FROM c),
b AS (SELECT file_id, -({total}) AS bm25 FROM c, s WHERE {' AND '.join(f'f{i} > 0' for i in range(len(ps)))})"""


def _sql_like(c: str, q: str) -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"contains({low.format(c)}, '{q.lower()}')"


def _sql_candidates(q: str, where: str = "true", engine: str | None = None) -> str:
    terms = S.query_terms(q)
    engine = engine or S.engine_for(q)[0]
    gram = " AND ".join("(" + " OR ".join(f"coalesce(contains(lower({c}), '{x.lower()}'), false)" for c in ("name", "path", "content")) + ")" for x in terms)
    word = [f"SELECT * FROM (SELECT k.*, 1 AS source, round(0.35 * least(1.0, greatest(0.0, -bm25 / 10)), 6) AS base FROM b JOIN k USING (file_id) ORDER BY bm25, file_id LIMIT 300)"]
    parts = word if engine != "like" else ["SELECT k.*, 1 AS source, 0.0 AS base FROM k WHERE false"]
    if engine == "word+gram":
        g = gram if all(len(x) >= 3 for x in terms) else "false"
        parts.append(f"SELECT * FROM (SELECT k.*, 2 AS source, 0.05 AS base FROM (SELECT file_id FROM t WHERE {g}) JOIN k USING (file_id) ORDER BY file_id LIMIT 300)")
    like = f"coalesce({_sql_like('k.name', q)} OR {_sql_like('k.rel_path', q)}, false) OR coalesce({_sql_like('t.content', q)}, false)"
    return f"""WITH {_FILES}, {_sql_bm25(q)}, k AS (SELECT file_id, kb_id, parent_rel, path, rel_path, name, ext, kind, size, mtime_ns FROM f WHERE {_LIVE} AND {where}),
w AS ({' UNION ALL '.join(parts)}), l AS (SELECT k.*, 3 AS source, 0.0 AS base FROM k LEFT JOIN t USING (file_id) WHERE {like} ORDER BY mtime_ns DESC, file_id LIMIT 500),
a AS (SELECT * FROM w UNION ALL SELECT * FROM l WHERE (SELECT count(DISTINCT file_id) FROM w) < 12),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY source) AS r FROM a) WHERE r = 1)"""


#: Icons of kinds, written out.
_ICON = """CASE WHEN page.kind IN ('pdf', 'markdown', 'text', 'docx') THEN 'fileText' WHEN page.kind = 'html' THEN 'globe' WHEN page.kind IN ('csv', 'xlsx') THEN 'chart' WHEN page.kind IN ('json', 'xml', 'yaml') THEN 'type'
  WHEN page.kind = 'pptx' THEN 'layers' WHEN page.kind = 'code' THEN 'terminal' WHEN page.kind = 'image' THEN 'image' WHEN page.kind = 'audio' THEN 'music' WHEN page.kind = 'video' THEN 'video' ELSE 'file' END"""


def _sql_total(q: str, engine: str | None = None) -> str:
    return f"(SELECT count(*) FROM ({_sql_candidates(q, engine=engine)} SELECT * FROM u))"


def _sql_mark(x: str, terms: list[str]) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    for t in sorted(dict.fromkeys(terms), key=lambda t: (-len(t), t)):
        x = f"regexp_replace({x}, '(?i)({t})', '<mark>\\1</mark>', 'g')"
    return x


def _sql_search(q: str, sort: str = "relevance", where: str = "true", limit: int = 40, favorites_only: bool = False, offset: int = 0) -> str:
    terms = S.query_terms(q)
    score = "base"
    for t in terms:
        t = t.lower()
        score += f" + CASE WHEN lower(name) = '{t}' THEN 4.0 WHEN starts_with(lower(name), '{t}') THEN 2.5 WHEN contains(lower(name), '{t}') THEN 1.8 ELSE 0 END + CASE WHEN contains(lower(rel_path), '{t}') THEN 0.9 ELSE 0 END"
    days = f"CASE WHEN mtime_ns = 0 THEN 0 ELSE greatest(0, {AS_OF} - mtime_ns / 1e9) / 86400 END"
    score += f" + CASE WHEN favorite THEN 0.4 ELSE 0 END + least(0.3, 0.3 * exp(-({days}) / 90))"
    at = "0"
    for t in reversed(terms):
        at = f"CASE WHEN strpos(lower(content), '{t.lower()}') > 0 THEN strpos(lower(content), '{t.lower()}') ELSE {at} END"
    start = f"greatest({at} - 61, 0)"
    keys = {"time": "mtime_ns DESC, score DESC, file_id", "name": "lower(name), score DESC, file_id"}.get(sort, "score DESC, lower(name), file_id")
    if favorites_only:
        where += " AND path IN (SELECT path FROM favorites WHERE path IS NOT NULL)"
    held = " AND ".join(f"contains(c, '{t.lower()}')" for t in terms) if all(len(t) >= 3 for t in terms) else "false"
    units = f"""hl AS (SELECT t.file_id, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS a FROM t JOIN page USING (file_id) WHERE kind = 'markdown' AND content IS NOT NULL),
he AS (SELECT file_id, a, len(a) AS n, unnest(a) AS line, unnest(range(len(a))) AS i FROM hl),
hh AS (SELECT *, row_number() OVER w AS no, coalesce(lead(i) OVER w, n) AS stop FROM he WHERE regexp_matches(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$') WINDOW w AS (PARTITION BY file_id ORDER BY i)),
hu AS (SELECT file_id, no, regexp_extract(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 2) AS label, lower(array_to_string(a[i + 1:stop], chr(10))) AS c FROM hh),
un AS (SELECT file_id, CAST(min(no) AS INT) AS unit_no, arg_min(label, no) AS unit_label FROM hu WHERE {held} GROUP BY 1)"""
    return f"""{_sql_candidates(q, where)}, m AS (SELECT u.*, coalesce(u.path IN (SELECT path FROM favorites WHERE path IS NOT NULL), false) AS favorite FROM u),
z AS (SELECT *, round({score}, 4) AS score FROM m), page AS (SELECT *, count(*) OVER () AS total FROM z ORDER BY {keys} LIMIT {limit}{f" OFFSET {offset}" if offset else ""}), {units}
SELECT page.file_id, page.name, page.rel_path, page.kind, page.ext, page.size, {_ICON} AS icon, unit_no, unit_label, score, favorite, total, CASE WHEN coalesce(content, '') = '' THEN {_sql_mark("coalesce(rel_path, '')", terms)}
  ELSE {_sql_mark(f"(CASE WHEN {start} > 0 THEN '… ' ELSE '' END || substr(content, {start} + 1, 220))", terms)} END AS snippet FROM page LEFT JOIN t USING (file_id) LEFT JOIN un USING (file_id)"""


QUERIES = {
    "ft_search_word": _search("backup archive"),
    "ft_search_prefix": _search("quota noteb", sort="time"),
    "ft_search_filtered": _search("contract", filters=S.Filters(kinds=["markdown", "text"], exts=["md", "TXT", ".log"], since=1500000000, until="2000000000"), sort="name"),
    "ft_search_badfilter": _search("filter", filters=S.Filters(kb_id=7, since="soon"), limit=10),
    "ft_search_favorites": _search("the", favorites_only=True),
    "ft_search_accents": _search("große überflüssig"),
    "ft_search_cjk": _search("打印机"),
    "ft_search_short_cjk": _search("索引"),
    "ft_search_page": _search("backup", offset=7, limit=5),
    "ft_search_prefixed": _search("backup", filters=S.Filters(prefix="/2016-3w/")),
    "ft_envelope": _envelope,
    "ft_suggest_recent": _recent,
    "ft_bm25_phrase": _bm25("old_backup"),
    "ft_bm25_two": _bm25("backup archiv"),
    "ft_bm25_scan": _bm25_scan,
    "ft_bm25_index": _index_changes,
    "ft_trigram": _grams,
    "ft_like": _likes,
    "ft_candidates_merge": _merge,
    "ft_suggest": _suggest,
    "ft_related": _related,
    "ft_postings_df": _df,
    "ft_highlight": _highlight,
}
SQL = {
    "ft_search_word": _sql_search("backup archive"),
    "ft_search_prefix": _sql_search("quota noteb", "time"),
    "ft_search_filtered": _sql_search("contract", "name", "kind IN ('markdown', 'text') AND ext IN ('.md', '.txt', '.log') AND mtime_ns >= 1500000000000000000 AND mtime_ns <= 2000000000000000000"),
    "ft_search_badfilter": _sql_search("filter", where="kb_id = 7", limit=10),
    "ft_search_favorites": _sql_search("the", favorites_only=True),
    "ft_search_accents": _sql_search("große überflüssig"),
    "ft_search_cjk": _sql_search("打印机"),
    "ft_bm25_phrase": f"WITH {_sql_bm25('old_backup')} SELECT file_id, round(bm25, 6) AS bm25 FROM b",
    "ft_bm25_two": f"WITH {_sql_bm25('backup archiv')} SELECT file_id, round(bm25, 6) AS bm25 FROM b",
    "ft_bm25_scan": f"WITH {_sql_bm25('backup archiv')} SELECT file_id, round(bm25, 6) AS bm25 FROM b",
    "ft_bm25_index": f"WITH {_sql_bm25('backup archiv').replace('FROM t)', 'FROM t WHERE file_id % 5 <> 0)')} SELECT file_id, round(bm25, 6) AS bm25 FROM b",
    "ft_search_short_cjk": _sql_search("索引"),
    "ft_search_page": _sql_search("backup", limit=5, offset=7),
    "ft_search_prefixed": _sql_search("backup", where="(rel_path = '2016-3w' OR starts_with(rel_path, '2016-3w/'))"),
    "ft_envelope": f"""SELECT * FROM (VALUES ('backup archive', 'backup~archive', 0, 200, 'word', false, ''), ('打印机 backup', '打印机~backup', 0, 200, 'word+gram', false, ''), ('索引', '索引', 0, 200, 'like', true, 'short terms'),
  ('backup', 'backup', 0, 200, 'like', true, 'no index')) AS v(query, terms, "offset", "limit", engine, degraded, hint) JOIN (SELECT 'backup archive' AS query, {_sql_total('backup archive')} AS total UNION ALL SELECT '打印机 backup', {_sql_total('打印机 backup')}
  UNION ALL SELECT '索引', {_sql_total('索引')} UNION ALL SELECT 'backup', {_sql_total('backup', 'like')}) USING (query)""",
    "ft_suggest_recent": f"""WITH {_FILES}, r AS (SELECT path, arg_max(name, (last_opened, name)) AS name, max(last_opened) AS last FROM recents WHERE path IS NOT NULL GROUP BY 1),
o AS (SELECT * FROM (SELECT path, file_id, rel_path, kind, row_number() OVER (PARTITION BY path ORDER BY file_id) AS rn FROM f) WHERE rn = 1)
SELECT file_id, r.name, coalesce(rel_path, '') AS rel_path, coalesce(kind, 'other') AS kind, -1 AS rank FROM r LEFT JOIN o USING (path) ORDER BY last DESC, r.path LIMIT 30""",
    "ft_trigram": f"""WITH {_TEXTS} SELECT file_id FROM t WHERE (contains(lower(name), '打印机') OR contains(lower(path), '打印机') OR contains(lower(content), '打印机'))
  AND (contains(lower(name), '索引、') OR contains(lower(path), '索引、') OR contains(lower(content), '索引、'))""",
    "ft_like": f"""WITH {_FILES}, {_TEXTS} SELECT f.file_id FROM f LEFT JOIN t USING (file_id) WHERE {_LIVE} AND (coalesce({_sql_like('f.name', 'draft.')}
  OR {_sql_like('f.rel_path', 'draft.')}, false) OR coalesce({_sql_like('t.content', 'draft.')}, false))""",
    "ft_candidates_merge": _sql_candidates("打印机 backup") + " SELECT file_id, source, base FROM u",
    "ft_suggest": f"""WITH {_FILES} SELECT file_id, name, rel_path, kind, CASE WHEN starts_with(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'dra')
  THEN 0 ELSE 1 END AS rank FROM f WHERE {_LIVE} AND ({_sql_like('name', 'dra')} OR {_sql_like('rel_path', 'dra')}) ORDER BY rank, length(name), name, file_id LIMIT 30""",
    "ft_related": f"""WITH {_FILES}, o AS (SELECT * FROM f WHERE {_LIVE} ORDER BY file_id LIMIT 1),
g AS (SELECT list_filter(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1) AS g FROM o),
r AS (SELECT f.file_id, f.name, f.rel_path, CASE WHEN f.parent_rel = o.parent_rel THEN 3.0 WHEN len(list_filter(g.g, lambda x: contains(lower(f.name), x))) > 0 THEN 2.0
  WHEN f.kind = o.kind THEN 1.0 END AS weight, f.mtime_ns FROM f JOIN o ON f.kb_id = o.kb_id AND f.file_id <> o.file_id, g WHERE NOT coalesce(f.is_deleted, false) AND NOT coalesce(f.is_dir, false))
SELECT * FROM r WHERE weight IS NOT NULL ORDER BY weight DESC, mtime_ns DESC, file_id LIMIT 12""",
    "ft_postings_df": f"""WITH {_TEXTS}, x AS (SELECT file_id, unnest(regexp_extract_all({_sql_fold('v')}, '[\\p{{L}}\\p{{N}}]+')) AS term
  FROM (SELECT file_id, unnest([name, path, content]) AS v FROM t))
SELECT term, count(DISTINCT file_id) AS df, count(*) AS n FROM x GROUP BY 1""",
    "ft_highlight": f"SELECT name, {_sql_mark('name', ['dra', 'a'])} AS marked FROM (SELECT DISTINCT name FROM files)",
}
