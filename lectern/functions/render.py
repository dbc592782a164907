"""Texts as safe HTML: Markdown, DOCX and plain text. All text is escaped, and links keep to what ``safe_link`` allows."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import UNSAFE_SCHEMES
from lectern.functions.text import html_escape

_INLINE = re.compile(
    r"`(?P<code>[^`]+)`|\*\*(?P<b1>\S(?:.*?\S)?)\*\*|__(?P<b2>\S(?:.*?\S)?)__|(?<![*\w])\*(?P<i1>[^*\s](?:[^*]*[^*\s])?)\*(?![*\w])|(?<![_\w])_(?P<i2>[^_\s](?:[^_]*[^_\s])?)_(?![_\w])"
    r"|~~(?P<del>\S(?:.*?\S)?)~~|(?P<bang>!?)\[(?P<label>[^\]]*)\]\((?P<url>[^)\s]+)(?:\s[^)]*)?\)"
)
_TAGS = {"b1": "strong", "b2": "strong", "i1": "em", "i2": "em", "del": "del"}
_PICTURES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg")
#: What a line can be, by the first alternative that matches.
_LINE = re.compile(
    r"(?P<blank>\s*$)|\s*(?P<fence>```+|~~~+)\s*(?P<lang>[\w+-]*)\s*$|(?P<rule>\s*([-*_])\s*(\5\s*){2,}$)|(?P<hashes>#{1,6})\s+(?P<title>.+?)\s*#*\s*$|\s*>(?P<quote>.*)$"
    r"|\s*\d+[.)]\s+(?P<ol>.+)$|\s*[-*+]\s+(?P<ul>.+)$|(?P<text>.*)$"
)
_COLUMNS = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")


def safe_url(url: str) -> str | None:
    """``safe_link`` for one string."""
    raw = url.strip()
    bare = re.sub(r"[\s\x00-\x1f\x7f]+", "", raw).lower()
    if not bare or bare.split(":", 1)[0] in UNSAFE_SCHEMES and ":" in bare or raw.startswith("//"):
        return None
    return raw if "://" not in raw or bare.startswith(("http:", "https:")) else None


def inline(text: str) -> str:
    """One run of text: code, bold, italic, struck, links; what is inside is rendered too, except in code. Links that aren't safe leave their
    label."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(html.escape(text[at : m.start()], quote=False))
        at = m.end()
        kind = m.lastgroup
        if m["code"] is not None:
            out.append(f"<code>{html.escape(m['code'], quote=False)}</code>")
        elif kind in _TAGS:
            out.append(f"<{_TAGS[kind]}>{inline(m[kind])}</{_TAGS[kind]}>")
        else:
            url, label = safe_url(m["url"]), inline(m["label"])
            if url is None:
                out.append(label)
                continue
            to = html.escape(url)
            picture = bool(m["bang"]) and url.lower().split("?")[0].endswith(_PICTURES)
            out.append(f'<a class="md-image" href="{to}" target="_blank" rel="noopener">[image] {label or to}</a>' if picture else f'<a href="{to}" target="_blank" rel="noopener noreferrer">{label or to}</a>')
    return "".join(out) + html.escape(text[at:], quote=False)


def _cells(row: str) -> list[str]:
    return [inline(c.strip()) for c in row.strip().strip("|").split("|")]


def _table(rows: list[str]) -> str:
    head = "".join(f"<th>{c}</th>" for c in _cells(rows[0]))
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in _cells(r)) + "</tr>" for r in rows[2:])
    return f'<table class="md-table"><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>'


def _parts(lines: list[str]) -> Iterator[tuple[str, object]]:
    """Lines with what they are; code blocks and tables as one part."""
    i = 0
    while i < len(lines):
        m = _LINE.match(lines[i])
        if m["fence"]:
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(m["fence"][:3])), len(lines))
            yield "code", (m["lang"], lines[i + 1 : end])
            i = end + 1
            continue
        if "|" in lines[i] and i + 1 < len(lines) and not m["quote"] and _COLUMNS.match(lines[i + 1]):
            end = next((j for j in range(i + 2, len(lines)) if "|" not in lines[j]), len(lines))
            yield "table", lines[i:end]
            i = end
            continue
        kind = next(k for k in ("blank", "rule", "hashes", "quote", "ol", "ul", "text") if m[k] is not None)
        yield kind, m if kind == "hashes" else m[kind]
        i += 1


def markdown_html(text: str | None, most: int = 20_000) -> str:
    """Headings, paragraphs, lists, quotes, rules, code blocks and tables; ``most`` blocks at most. Null and empty give nothing."""
    out: list[str] = []
    for kind, group in groupby(_parts(re.split("\r\n|\r|\n", text or "")), key=lambda p: p[0]):
        items = [x for _, x in group]
        if kind == "text":
            out.append(f"<p>{inline(' '.join(x.strip() for x in items))}</p>")
        elif kind in ("ol", "ul"):
            out.append(f"<{kind}>" + "".join(f"<li>{inline(x)}</li>" for x in items) + f"</{kind}>")
        elif kind == "quote":
            out.append(f"<blockquote>{inline(' '.join(x.strip() for x in items))}</blockquote>")
        elif kind == "rule":
            out += ["<hr/>"] * len(items)
        elif kind == "hashes":
            out += [f"<h{len(m['hashes'])}>{inline(m['title'])}</h{len(m['hashes'])}>" for m in items]
        elif kind == "table":
            out += map(_table, items)
        elif kind == "code":
            for lang, body in items:
                name = f' class="lang-{html.escape(lang)}"' if lang else ""
                out.append(f"<pre{name}><code>{html.escape(chr(10).join(body), quote=False)}</code></pre>")
    return "\n".join(out[:most])


def plain_html(c: Column, most: int = 200_000) -> Column:
    """Plain text with its lines, ``most`` characters at most; null and empty give nothing."""
    body = html_escape(F.substring(c, 1, most), quotes=False)
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(F.lit('<pre class="plain">'), body, F.lit("</pre>")))


def docx_html(data: bytes, most: int = 20_000) -> str:
    """Paragraphs, headings and tables of a DOCX file."""
    from lectern.sources.office import docx_blocks

    out = []
    for level, rows in docx_blocks(data):
        if isinstance(rows, str):
            tag = f"h{min(6, level)}" if level else "p"
            if rows.strip():
                out.append(f"<{tag}>{inline(rows)}</{tag}>")
        elif any(any(r) for r in rows):
            out.append('<table class="doc-table"><tbody>' + "".join("<tr>" + "".join(f"<td>{html.escape(c, quote=False)}</td>" for c in r) + "</tr>" for r in rows if any(r)) + "</tbody></table>")
    if len(out) > most:
        out = [*out[:most], '<p class="doc-truncated">…</p>']
    return "\n".join(out)


def rendered(texts: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, html) of Markdown texts."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([markdown_html(x) for x in b.column(1).to_pylist()], pa.string())], [key, "html"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, html string")
