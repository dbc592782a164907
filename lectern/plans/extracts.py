"""Round trips: the texts of the library written in each format and read back by its extractor; folders walked."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.corpus import table, texts
from lectern.functions import render
from lectern.session import scratch, spread
from lectern.sources import office, walker
from lectern.sources.extract import extract_files


def _lines(text: str) -> list[str]:
    clean = "".join(c for c in text if c >= " " or c == "\n")
    return [x for x in clean.split("\n") if x.strip()]


_CHARSETS = {"de": "cp1252", "zh": "gb18030", "ja": "shift_jis", "ru": "cp1251"}


def _pdf(lines: list[str]) -> bytes:
    """A PDF of one page for each 40 lines of printable ASCII."""
    pages = [lines[i : i + 40] for i in range(0, len(lines), 40)] or [[]]
    n = len(pages)
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(n))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {n} >>"]
    for i, page in enumerate(pages):
        shown = " T* ".join("(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") Tj" for x in page)
        stream = f"BT /F1 10 Tf 12 TL 40 800 Td {shown} ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >> >> >>")
        objects.append(f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream")
    out, places = "%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n{o}\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return (out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF").encode("ascii")


def _write(kind: str):
    def one(text: str) -> bytes:
        if kind == "docx":
            return office.make_docx(_lines(text))
        if kind == "pptx":
            return office.make_pptx([_lines(p) for p in text.split("\n\n")])
        if kind == "xlsx":
            return office.make_xlsx([("s", [r.split(" | ") for r in _lines(text)])])
        if kind == "pdf":
            return _pdf([re.sub(r"[^ -~]", "", x) for x in text.split("\n")])
        return text.encode("utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [one(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["file_id", "kind", "content"])

    return run


def _round(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = texts(table(spark, sf, "files"), table(spark, sf, "file_text"), ["kind"]).filter(F.col("kind") == kind)
        made = rows.select("file_id", "kind", "content").mapInArrow(_write(kind), "file_id long, kind string, content binary")
        out = extract_files(made, "file_id", most=0, rows=0)
        bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")
        return out.select("file_id", "state", F.md5(bare).alias("digest"), "truncated")

    return run


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, lang, data) for i, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if (data := _legacy(text, lang)) is not None]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(["text"] * len(rows), pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[1], pa.string())], ["doc_id", "kind", "content", "lang"])


def _legacy(text: str, lang: str) -> bytes | None:
    try:
        return text.encode(_CHARSETS[lang])
    except UnicodeEncodeError:
        return None


_SCRIPT = {"de": "[äöüß].*[äöüß]", "zh": "[一-鿿]{4}", "ja": "[ぁ-ん].{0,9}[ぁ-ん]", "ru": "[а-я]{4}"}


def _charsets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written in the legacy charset of their language and read back: how many come back as they were."""
    docs = table(spark, sf, "documents")
    fits = reduce(lambda a, b: a | b, [(F.col("lang") == k) & F.col("text").rlike(f"(?s){p}") for k, p in _SCRIPT.items()])
    rows = docs.filter(fits & (F.length("text") >= 100) & ~F.col("text").contains("\0")).select("doc_id", "lang", "text")
    made = spread(rows).mapInArrow(_encoded, "doc_id long, kind string, content binary, lang string")
    out = extract_files(made, "doc_id", most=0).select("doc_id", F.col("text").alias("read"))
    both = out.join(rows.select("doc_id", "lang", "text"), "doc_id")
    return both.groupBy("lang").agg((F.count_if(F.col("read") == F.col("text")) / F.count("*") >= 0.97).alias("kept"))


def _html(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of HTML files without their character references, compared by its words."""
    rows = texts(table(spark, sf, "files"), table(spark, sf, "file_text"), ["kind"]).filter(F.col("kind") == "html").select("file_id", "kind", F.encode(F.regexp_replace("content", "&#?[A-Za-z0-9]+;", ""), "utf-8").alias("content"))
    out = extract_files(rows, "file_id", most=0)
    return out.select("file_id", F.md5(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\u0085\p{Z}]+", "")).alias("digest"))


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of three rows of each sheet."""
    rows = texts(table(spark, sf, "files"), table(spark, sf, "file_text"), ["kind"]).filter(F.col("kind") == "xlsx")
    made = rows.select("file_id", "kind", "content").mapInArrow(_write("xlsx"), "file_id long, kind string, content binary")

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [office.sheet_page(d, 0, 3, 3) for d in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["~".join(g["columns"]) for g in got]), pa.array(["/".join("~".join(r["c"]) for r in g["rows"]) for g in got]), pa.array([g["has_more"] for g in got])], ["file_id", "columns", "cells", "has_more"])

    return made.mapInArrow(page, "file_id long, columns string, cells string, has_more boolean")


def _library(spark: SparkSession) -> str:
    """A folder tree with links, empty, deep and excluded folders, in the shared folder: the walk reads folders that its executors see."""
    root = os.path.join(re.sub("^file:(//)?", "", scratch(spark, "walk")), "library")
    for name, data in (("guide.md", "# A"), ("notes/readme.txt", "x"), ("notes/a b/ü.csv", "a,b"), ("sub/deep/er/nested.md", "y"), ("node_modules/x.js", "z"), ("empty.txt", "")):
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w") as f:
            f.write(data)
    os.symlink("guide.md", os.path.join(root, "link.md"))
    os.makedirs(os.path.join(root, "hollow"))
    return root


def _walk(spark: SparkSession, sf: str) -> DataFrame:
    """The tree walked and joined to kinds, as the catalogue takes it."""
    walker.register(spark)
    return walker.entries(spark, _library(spark), max_depth=3).select("rel_path", "parent_rel", "name", "ext", "kind", "size", "is_dir", "is_symlink", "depth", "truncated")


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    walker.register(spark)
    return walker.list_folder(spark, _library(spark), limit=7).select("name", "is_dir", "kind", "size")


def _rendered(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown files as HTML: headings and code blocks in it, and whether anything could run."""
    rows = texts(table(spark, sf, "files"), table(spark, sf, "file_text"), ["kind"]).filter(F.col("kind") == "markdown")
    out = render.rendered(rows)
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    return out.select("file_id", count("<h[1-6]>").alias("headings"), count("<pre").alias("codes"), F.col("html").rlike(r"(?i)<(script|iframe|img|svg)\b|href=\"(javascript|data):").alias("unsafe"))


def _plain(spark: SparkSession, sf: str) -> DataFrame:
    rows = texts(table(spark, sf, "files"), table(spark, sf, "file_text"), ["kind"]).filter(F.col("kind") == "text")
    return rows.select("file_id", F.md5(render.plain_html(F.col("content"))).alias("digest"))


_T = "(SELECT DISTINCT t.file_id, content, kind FROM file_text t JOIN (SELECT DISTINCT id, kind FROM files) f ON f.id = t.file_id WHERE content IS NOT NULL)"


def _sql(kind: str) -> str:
    if kind == "pdf":
        bare = "regexp_replace(content, '[^!-~]', '', 'g')"
        return f"""SELECT file_id, CASE WHEN {bare} = '' THEN 'empty' ELSE 'ok' END AS state, md5({bare}) AS digest, false AS truncated FROM {_T} WHERE kind = 'pdf'"""
    text = "regexp_replace(content, '[\\x00-\\x1f]', '', 'g')" if kind != "text" else "content"
    bare = f"regexp_replace({text}, '\\s+', '', 'g')"
    return f"""SELECT file_id, CASE WHEN trim({bare}) = '' THEN 'empty' ELSE 'ok' END AS state, md5({bare}) AS digest, false AS truncated FROM {_T} WHERE kind = '{kind}'"""


_KINDS = ("docx", "pptx", "text", "xlsx", "pdf")
_ROWS = "list_filter(string_split(regexp_replace(content, '[\\x00-\\x09\\x0b-\\x1f]', '', 'g'), chr(10)), lambda x: trim(x) <> '')"
QUERIES = {f"x_{k}": _round(k) for k in _KINDS} | {"x_charset": _charsets, "html_text": _html, "xlsx_page": _sheet, "x_walk": _walk, "x_list": _listed, "md_html": _rendered, "text_html": _plain}
SQL = {f"x_{k}": _sql(k) for k in _KINDS} | {
    "x_charset": "SELECT * FROM (VALUES ('de', true), ('zh', true), ('ja', true), ('ru', true)) AS t(lang, kept)",
    "html_text": f"""WITH a AS (SELECT file_id, regexp_replace(regexp_replace(content, '&#?[A-Za-z0-9]+;', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS c FROM {_T} WHERE kind = 'html'),
b AS (SELECT file_id, regexp_replace(c, '(?is)<head\\b.*?</head>|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g') AS c FROM a)
SELECT file_id, md5(regexp_replace(regexp_replace(c, '<[/!?]?[A-Za-z][^>]*>', '', 'g'), '[\\s\\x{{85}}\\p{{Z}}]+', '', 'g')) AS digest FROM b""",
    "xlsx_page": f"""WITH l AS (SELECT file_id, list_transform({_ROWS}, lambda x: list_transform(string_split(x, ' | '), lambda c: trim(c))) AS a FROM {_T} WHERE kind = 'xlsx')
SELECT file_id, coalesce(array_to_string(a[1], '~'), '') AS columns, array_to_string(list_transform(a[5:7], lambda r: array_to_string(r, '~')), '/') AS cells, len(a) > 7 AS has_more FROM l""",
    "x_list": "SELECT * FROM (VALUES ('hollow', true, 'dir', 0), ('node_modules', true, 'dir', 0), ('notes', true, 'dir', 0), ('sub', true, 'dir', 0), ('empty.txt', false, 'text', 0), ('guide.md', false, 'markdown', 3), ('link.md', false, 'markdown', 8)) AS t(name, is_dir, kind, size)",
    "md_html": f"""WITH l AS (SELECT file_id, unnest(regexp_split_to_array(content, '\\r\\n|\\r|\\n')) AS x FROM {_T} WHERE kind = 'markdown'),
n AS (SELECT file_id, count(*) FILTER (regexp_matches(x, '^#{{1,6}}\\s+\\S')) AS headings, count(*) FILTER (regexp_matches(x, '^\\s*(```+|~~~+)\\s*[\\w+-]*\\s*$')) AS fences FROM l GROUP BY 1)
SELECT file_id, headings, (fences + 1) // 2 AS codes, false AS unsafe FROM n""",
    "text_html": f"""SELECT file_id, md5(CASE WHEN content = '' THEN '' ELSE '<pre class="plain">' || replace(replace(replace(substr(content, 1, 200000), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre>' END) AS digest FROM {_T} WHERE kind = 'text'""",
    "x_walk": """SELECT * FROM (VALUES ('empty.txt', '', 'empty.txt', '.txt', 'text', 0, false, false, 1, false), ('guide.md', '', 'guide.md', '.md', 'markdown', 3, false, false, 1, false), ('hollow', '', 'hollow', '', 'dir', 0, true, false, 1, false),
  ('link.md', '', 'link.md', '.md', 'markdown', 8, false, true, 1, false), ('notes', '', 'notes', '', 'dir', 0, true, false, 1, false), ('notes/a b', 'notes', 'a b', '', 'dir', 0, true, false, 2, false),
  ('notes/a b/ü.csv', 'notes/a b', 'ü.csv', '.csv', 'csv', 3, false, false, 3, false), ('notes/readme.txt', 'notes', 'readme.txt', '.txt', 'text', 1, false, false, 2, false), ('sub', '', 'sub', '', 'dir', 0, true, false, 1, false),
  ('sub/deep', 'sub', 'deep', '', 'dir', 0, true, false, 2, false), ('sub/deep/er', 'sub/deep', 'er', '', 'dir', 0, true, false, 3, true)) AS t(rel_path, parent_rel, name, ext, kind, size, is_dir, is_symlink, depth, truncated)""",
}
