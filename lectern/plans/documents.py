"""Queries of scalar functions and of units of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.corpus import table, texts
from lectern.functions import scalars as X
from lectern.operators import documents as D


def _texts(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    rows = texts(table(spark, sf, "files"), table(spark, sf, "file_text"), ["kind"])
    return rows.filter(F.col("kind").isin(*kinds)) if kinds else rows


def _names(**cols):
    return lambda spark, sf: table(spark, sf, "files").select("name", "path", "rel_path", "size").distinct().select("path", *[c().alias(k) for k, c in cols.items()])



_MSG = """(VALUES (1, 'Authorization: Bearer abcdef123456 ok'), (2, 'password=hunter22; x=1'), (3, 'Cookie: sid=1; b=2'), (4, 'api_key: ZZZZ9, next'), (5, 'plain'), (6, NULL), (7, 'auth=abcd1234'),
  (8, 'X-Csrf-Token=abcdef12; a'), (9, 'basic QWxhZGRpbjpvcGVu'), (10, 'pwd = ab'), (11, '{"secret": "x"} private-key=zzzz]'), (12, 'TMSESSNAME=0123456789; path=/')) AS t(id, s)"""
_URI = """(VALUES (1, 'java\tscript:alert(1)'), (2, 'https://a.b/c?d=1&e=2'), (3, 'DATA:text/html,x'), (4, '#top'), (5, '../x.md'), (6, 'ftp://x'), (7, NULL), (8, '//evil.example/x'), (9, 'tel:+49123'), (10, 'a b/ü.md'),
  (11, ' mailto:x@y '), (12, ''), (13, 'file:///etc'), (14, '/abs'), (15, 'notes:today')) AS t(id, s)"""
_NUM = "(VALUES (1, '12'), (2, 'x'), (3, '-5'), (4, '99999'), (5, NULL), (6, '')) AS t(id, s)"
_DAY = "(VALUES (1, 45000.0D), (2, 60.0D), (3, 59.0D), (4, 1.0D), (5, 2958465.0D), (6, 61.5D), (7, 45000.25D), (8, -1.0D), (9, 3000000.0D), (10, CAST(NULL AS DOUBLE)), (11, 43000.9999999D)) AS t(id, s)"
_SIZES = "(VALUES (1, 0L), (2, 1023L), (3, 1024L), (4, 1280L), (5, 1792L), (6, 1048575L), (7, 2251799813685248L), (8, 1099511627776L), (9, NULL), (10, 9223372036854775807L)) AS t(id, s)"
_FILES = """(VALUES (1, 'A.PYI'), (2, 'x.mjs'), (3, 'x.cc'), (4, 'x.bash'), (5, 'x.svelte'), (6, 'x.cmake'), (7, 'app.dockerfile'), (8, 'Dockerfile'), (9, 'CMakeLists.txt'), (10, 'README'), (11, 'x.h'), (12, 'x.cs'), (13, 'x.kt'),
  (14, 'x.tsx'), (15, 'x.docx'), (16, 'x.yaml'), (17, 'x.jsonl'), (18, 'x.png'), (19, 'noext'), (20, '.env'), (21, 'x.toml'), (22, 'a.tar.gz'), (23, 'x.mp3'), (24, 'x.conf'), (25, 'x.less'), (26, 'x.unknown'), (27, 'Makefile'), (28, 'x.pptx'), (29, 'x.ps1'), (30, 'x.md')) AS t(id, s)"""
_SAFE = """(VALUES (1, 'a/b\\\\c.txt'), (2, ' .hidden. '), (3, 'say "hi"'), (4, ''), (5, NULL), (6, 'a:b*c?d<e>f|g'), (7, '...'), (8, 'tab\there')) AS t(id, s)"""
_REF = "(VALUES (1, 'A1'), (2, 'Z9'), (3, 'AA10'), (4, 'xfd1'), (5, 'BC')) AS t(id, s)"
_RNG = "(VALUES (1, 'bytes=0-99'), (2, 'bytes=500-'), (3, 'bytes=-100'), (4, 'bytes=2000-'), (5, 'x'), (6, 'bytes=-'), (7, 'bytes=900-5000'), (8, 'bytes=-0'), (9, 'bytes=0-')) AS t(id, s)"
_PNG = "(VALUES (1, X'89504E470D0A1A0A0000000D49484452000000100000000C'), (2, X'474946383961200010'), (3, X'00')) AS t(id, s)"


def _sql_case(values: dict[str, str], c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


#: What the extensions of the test tables stand for, written out.
_KINDS_HERE = {
    ".csv": ("csv", "", "text/csv"), ".tsv": ("csv", "", "text/tab-separated-values"), ".docx": ("docx", "", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ".flac": ("audio", "", "application/octet-stream"),
    ".go": ("code", "go", "text/plain"), ".htm": ("html", "html", "text/html"), ".html": ("html", "html", "text/html"), ".jpg": ("image", "", "image/jpeg"), ".js": ("code", "javascript", "text/javascript"), ".json": ("json", "json", "application/json"),
    ".jsonl": ("json", "", "application/json"), ".log": ("text", "log", "text/plain"), ".markdown": ("markdown", "markdown", "text/markdown"), ".md": ("markdown", "markdown", "text/markdown"), ".mkv": ("video", "", "application/octet-stream"), ".mp3": ("audio", "", "audio/mpeg"),
    ".mp4": ("video", "", "video/mp4"), ".pdf": ("pdf", "", "application/pdf"), ".png": ("image", "", "image/png"), ".pptx": ("pptx", "", "application/vnd.openxmlformats-officedocument.presentationml.presentation"), ".py": ("code", "python", "text/x-python"),
    ".rst": ("text", "rst", "text/x-rst"), ".sh": ("code", "bash", "application/x-sh"), ".txt": ("text", "", "text/plain"), ".webp": ("image", "", "image/webp"), ".xlsx": ("xlsx", "", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ".xml": ("xml", "xml", "text/xml"), ".yaml": ("yaml", "yaml", "application/x-yaml"), ".yml": ("yaml", "yaml", "application/x-yaml"), ".bin": ("other", "", "application/octet-stream"), ".zip": ("other", "", "application/zip"),
}
_EXT = "lower(regexp_extract(name, '^\\.*[^.].*?(\\.[^.]*)$', 1))"


def _here(i: int, default: str) -> str:
    return f"CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _KINDS_HERE.items()) + f" ELSE '{default}' END"


_D = "(SELECT DISTINCT name, path, rel_path, size FROM files)"
_T = "(SELECT DISTINCT t.file_id, content, kind FROM file_text t JOIN (SELECT DISTINCT id, kind FROM files) f ON f.id = t.file_id WHERE content IS NOT NULL)"
_LINES = "regexp_split_to_array(content, '\\r\\n|\\r|\\n')"
_FULL = f"list_filter({_LINES}, lambda x: trim(x) <> '')"


def _values(rows: list[tuple], names: str) -> str:
    """Expected values, written out."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS t({names})"


QUERIES = {
    "sc_ext_kind_lang": _names(ext=lambda: X.ext(F.col("name")), kind=lambda: X.kind(F.col("name")), lang=lambda: X.language(F.col("name")), mime=lambda: X.mime(F.col("name"))),
    "sc_paths": _names(parent=lambda: X.parent(F.col("rel_path")), base=lambda: X.basename(F.col("rel_path")), crumbs=lambda: F.array_join(X.prefixes(F.col("rel_path")), ">"), excluded=lambda: X.excluded(F.col("rel_path"))),
    "sc_escape": _names(html=lambda: X.html_escape(F.col("name")), like_name=lambda: X.like_escape(F.col("name")), safe=lambda: X.safe_filename(F.col("name")), cjk=lambda: X.cjk_count(F.col("name"))),
    "sc_human_size": _names(shown=lambda: X.human_size(F.col("size"))),
    "sc_names": lambda spark, sf: spark.sql(f"SELECT * FROM {_FILES}").select("id", X.kind(F.col("s")).alias("kind"), X.language(F.col("s")).alias("lang"), X.mime(F.col("s")).alias("mime")),
    "sc_excluded": lambda spark, sf: spark.sql("SELECT explode(array('.git','.svn','.hg','.bzr','node_modules','__pycache__','.venv','venv','.tox','.mypy_cache','.pytest_cache','.ruff_cache','target','dist','build','@eaDir','#recycle','$RECYCLE.BIN','.Trash','.Trashes','.Spotlight-V100','System Volume Information','lost+found','.idea','src','Target')) AS d").select("d", X.excluded(F.concat(F.lit("a/"), "d", F.lit("/b"))).alias("out")),
    "sc_sizes": lambda spark, sf: spark.sql(f"SELECT * FROM {_SIZES}").select("id", X.human_size(F.col("s")).alias("shown")),
    "sc_safe_name": lambda spark, sf: spark.sql(f"SELECT * FROM {_SAFE}").select("id", X.safe_filename(F.col("s")).alias("safe")),
    "sc_redact": lambda spark, sf: spark.sql(f"SELECT * FROM {_MSG}").select("id", X.redact(F.col("s")).alias("s")),
    "sc_uri": lambda spark, sf: spark.sql(f"SELECT * FROM {_URI}").select("id", X.dangerous_uri(F.col("s")).alias("bad"), X.safe_link(F.col("s")).alias("link")),
    "sc_clamp": lambda spark, sf: spark.sql(f"SELECT * FROM {_NUM}").select("id", X.clamp(F.col("s"), 1, 200, 40).alias("v")),
    "sc_xlsx_date": lambda spark, sf: spark.sql(f"SELECT * FROM {_DAY}").select("id", X.excel_date(F.col("s")).alias("d")),
    "sc_xlsx_col": lambda spark, sf: spark.sql(f"SELECT * FROM {_REF}").select("id", X.column_index(F.col("s")).alias("c")),
    "sc_range_parse": lambda spark, sf: spark.sql(f"SELECT * FROM {_RNG}").select("id", X.byte_range(F.col("s"), F.when(F.col("id") == 9, 10_000_000).otherwise(1000)).alias("r")).select("id", "r.start", "r.end"),
    "sc_image_header": lambda spark, sf: spark.sql(f"SELECT * FROM {_PNG}").select("id", F.coalesce(X.png_size(F.col("s")), X.gif_size(F.col("s"))).alias("z")).select("id", "z.w", "z.h"),
    "md_sections": lambda spark, sf: D.sections(_texts(spark, sf, "markdown")),
    "ft_units": lambda spark, sf: D.locate_units(D.section_texts(_texts(spark, sf, "markdown")), ["backup", "The"]),
    "csv_units": lambda spark, sf: D.row_blocks(_texts(spark, sf, "csv", "xlsx")),
    "csv_page": lambda spark, sf: D.row_page(_texts(spark, sf, "csv"), 1, 3).select("file_id", "r", F.array_join("c", "~").alias("cells")),
    "yaml_keys": lambda spark, sf: _texts(spark, sf, "yaml").select("file_id", F.array_join(X.yaml_keys(F.col("content")), " ").alias("keys")),
    "html_title": lambda spark, sf: _texts(spark, sf, "html").select("file_id", X.html_title(F.col("content")).alias("title")),
    "json_flatten": lambda spark, sf: D.flat_json(table(spark, sf, "events").select("event_id", "props"), "event_id", "props"),
    "text_window": lambda spark, sf: D.window_of(_texts(spark, sf), 1000, 500),
}
SQL = {
    "sc_ext_kind_lang": f"SELECT path, {_EXT} AS ext, {_here(0, 'other')} AS kind, {_here(1, '')} AS lang, {_here(2, 'application/octet-stream')} AS mime FROM {_D}",
    "sc_names": _values([
        (1, "code", "python", "text/plain"), (2, "code", "javascript", "text/javascript"), (3, "code", "cpp", "text/plain"), (4, "code", "bash", "text/plain"), (5, "code", "svelte", "text/plain"), (6, "code", "", "text/plain"), (7, "code", "", "text/plain"),
        (8, "code", "", "text/x-dockerfile"), (9, "text", "", "text/x-cmake"), (10, "text", "", "text/plain"), (11, "code", "c", "text/plain"), (12, "code", "csharp", "text/plain"), (13, "code", "kotlin", "text/plain"), (14, "code", "typescript", "text/plain"),
        (15, "docx", "", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), (16, "yaml", "yaml", "application/x-yaml"), (17, "json", "", "application/json"), (18, "image", "", "image/png"), (19, "other", "", "application/octet-stream"),
        (20, "other", "", "application/octet-stream"), (21, "text", "toml", "text/plain"), (22, "other", "", "application/x-tar"), (23, "audio", "", "audio/mpeg"), (24, "text", "ini", "text/plain"), (25, "code", "less", "text/plain"), (26, "other", "", "application/octet-stream"),
        (27, "code", "", "text/x-makefile"), (28, "pptx", "", "application/vnd.openxmlformats-officedocument.presentationml.presentation"), (29, "code", "powershell", "text/plain"), (30, "markdown", "markdown", "text/markdown"),
    ], "id, kind, lang, mime"),
    "sc_excluded": _values([(d, True) for d in [".git", ".svn", ".hg", ".bzr", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", "dist", "build", "@eaDir", "#recycle", "$RECYCLE.BIN", ".Trash", ".Trashes", ".Spotlight-V100", "System Volume Information", "lost+found"]] + [(".idea", False), ("src", False), ("Target", False)], "d, out"),
    "sc_sizes": _values([(1, "0 B"), (2, "1023 B"), (3, "1.0 KB"), (4, "1.2 KB"), (5, "1.8 KB"), (6, "1024.0 KB"), (7, "2.0 PB"), (8, "1.0 TB"), (9, "0 B"), (10, "8192.0 PB")], "id, shown"),
    "sc_safe_name": _values([(1, "a_b_c.txt"), (2, "hidden"), (3, "say 'hi'"), (4, "download"), (5, "download"), (6, "a:b*c?d<e>f|g"), (7, "download"), (8, "tab_here")], "id, safe"),
    "sc_paths": f"""SELECT path, regexp_replace(rel_path, '(^|/)[^/]*$', '') AS parent, regexp_extract(rel_path, '([^/]*)$', 1) AS base,
  array_to_string(list_transform(range(1, len(list_filter(string_split(rel_path, '/'), lambda x: x <> '')) + 1), lambda i: array_to_string(list_filter(string_split(rel_path, '/'), lambda x: x <> '')[1:i], '/')), '>') AS crumbs,
  regexp_matches(rel_path, '(^|/)(\\.git|\\.svn|\\.hg|\\.bzr|node_modules|__pycache__|\\.?venv|\\.tox|\\.(mypy|pytest|ruff)_cache|target|dist|build|@eaDir|#recycle|\\$RECYCLE\\.BIN|\\.Trash(es)?|\\.Spotlight-V100|System Volume Information|lost\\+found)(/|$)') AS excluded FROM {_D}""",
    "sc_escape": f"""SELECT path, replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
  replace(replace(name, '%', '\\%'), '_', '\\_') AS like_name, substr(trim(replace(regexp_replace(trim(name), '[\\x00-\\x1f\\x7f/\\\\]+', '_', 'g'), '"', ''''), '. '), 1, 180) AS safe,
  length(name) - length(regexp_replace(name, '[぀-ヿ㐀-鿿가-힯]', '', 'g')) AS cjk FROM {_D}""",
    "sc_human_size": f"""SELECT path, CASE WHEN size IS NULL THEN '0 B' WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576)
  WHEN size < 1099511627776 THEN printf('%.1f GB', size / 1073741824) ELSE printf('%.1f TB', size / 1099511627776) END AS shown FROM {_D}""",
    "sc_redact": _values([(1, "Authorization: ***REDACTED*** ***REDACTED*** ok"), (2, "password=***REDACTED***; x=1"), (3, "Cookie: ***REDACTED***; b=2"), (4, "api_key: ***REDACTED***, next"), (5, "plain"), (6, None), (7, "auth=***REDACTED***"), (8, "X-Csrf-Token=***REDACTED***; a"), (9, "basic ***REDACTED***"), (10, "pwd = ab"), (11, '{"secret": "x"} private-key=***REDACTED***]'), (12, "TMSESSNAME=***REDACTED***; path=/")], "id, s"),
    "sc_uri": _values([(1, True, None), (2, False, "https://a.b/c?d=1&e=2"), (3, True, None), (4, False, "#top"), (5, False, "../x.md"), (6, False, None), (7, False, None), (8, False, None), (9, False, "tel:+49123"), (10, False, "a b/ü.md"), (11, False, "mailto:x@y"), (12, False, None), (13, True, None), (14, False, "/abs"), (15, False, "notes:today")], "id, bad, link"),
    "sc_clamp": f"SELECT id, greatest(1, least(200, coalesce(try_cast(s AS INT), 40))) AS v FROM {_NUM}",
    "sc_xlsx_date": _values([(1, "2023-03-15"), (2, "1900-02-29"), (3, "1900-02-28"), (4, "1900-01-01"), (5, "9999-12-31"), (6, "1900-03-01 12:00:00"), (7, "2023-03-15 06:00:00"), (8, "-1.0"), (9, "3000000.0"), (10, None), (11, "2017-09-23 00:00:00")], "id, d"),
    "sc_xlsx_col": "SELECT * FROM (VALUES (1, 0), (2, 25), (3, 26), (4, 16383), (5, 54)) AS t(id, c)",
    "sc_range_parse": "SELECT * FROM (VALUES (1, 0, 99), (2, 500, 999), (3, 900, 999), (4, NULL, NULL), (5, NULL, NULL), (6, NULL, NULL), (7, 900, 999), (8, NULL, NULL), (9, 0, 4194303)) AS t(id, \"start\", \"end\")",
    "sc_image_header": "SELECT * FROM (VALUES (1, 16, 12), (2, 32, 16), (3, NULL, NULL)) AS t(id, w, h)",
    "md_sections": f"""WITH l AS (SELECT file_id, {_LINES} AS a FROM {_T} WHERE kind = 'markdown'), e AS (SELECT file_id, len(a) AS n, unnest(a) AS line, unnest(range(len(a))) AS i FROM l),
h AS (SELECT * FROM e WHERE regexp_matches(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$'))
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY i) AS unit_no, length(regexp_extract(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 1)) AS level,
  regexp_extract(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 2) AS label, i AS start_line, coalesce(lead(i) OVER (PARTITION BY file_id ORDER BY i), n) - i AS lines FROM h""",
    "ft_units": f"""WITH l AS (SELECT file_id, {_LINES} AS a FROM {_T} WHERE kind = 'markdown'), e AS (SELECT file_id, a, len(a) AS n, unnest(a) AS line, unnest(range(len(a))) AS i FROM l),
h AS (SELECT *, row_number() OVER w AS unit_no, coalesce(lead(i) OVER w, n) AS stop FROM e WHERE regexp_matches(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$') WINDOW w AS (PARTITION BY file_id ORDER BY i)),
u AS (SELECT file_id, unit_no, regexp_extract(line, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 2) AS label, lower(array_to_string(a[i + 1:stop], chr(10))) AS c FROM h),
k AS (SELECT file_id, unit_no, label FROM u WHERE contains(c, 'backup') AND contains(c, 'the'))
SELECT file_id, min(unit_no) AS unit_no, arg_min(label, unit_no) AS label FROM k GROUP BY 1 ORDER BY file_id LIMIT 20""",
    "csv_units": f"""WITH l AS (SELECT file_id, {_FULL} AS a FROM {_T} WHERE kind IN ('csv', 'xlsx')), e AS (SELECT file_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM l)
SELECT file_id, i // 200 AS block, min(i) AS first_row, count(*) AS rows, arg_min(line, i) AS head FROM e WHERE i < 20000 GROUP BY 1, 2""",
    "csv_page": f"""WITH l AS (SELECT file_id, {_FULL}[2:4] AS a FROM {_T} WHERE kind = 'csv')
SELECT file_id, unnest(range(len(a))) + 1 AS r, replace(unnest(a), ' | ', '~') AS cells FROM l""",
    "yaml_keys": f"SELECT file_id, array_to_string(regexp_extract_all(content, '(?m)^([A-Za-z_][\\w.\\-]*)\\s*:', 1), ' ') AS keys FROM {_T} WHERE kind = 'yaml'",
    "html_title": f"SELECT file_id, trim(regexp_replace(regexp_extract(content, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM {_T} WHERE kind = 'html'",
    "json_flatten": "WITH e AS (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL) SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM e WHERE json_extract_string(props, '$.' || k) IS NOT NULL",
    "text_window": f"SELECT file_id, substr(content, 1001, 500) AS part, length(content) > 1500 AS more FROM {_T}",
}
