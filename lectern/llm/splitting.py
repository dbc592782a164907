"""Splitting oversized items at natural boundaries (problem 2).

Method: balanced targets. A text of L characters with the limit M and the overlap O needs at least k = 1 + ceil((L - M) / (M - O))
pieces. k equal-length targets are placed; each is snapped to the strongest boundary nearby that keeps the piece within M; if the
last piece is then too long, k grows by one and all targets are placed anew.

Boundaries depend on the kind: headings and blank lines in prose, top-level definitions in code, rows in tables, top-level keys in
YAML, closing tags in markup; then lines, sentences, clauses, words. If none is near the target, the strongest in the whole
feasible range is taken; only a text with none there is cut between two characters, never inside CR LF or before a combining
mark, joiner or variation selector if that can be helped.

Piece i + 1 starts exactly O characters before the end of piece i, so the pieces without their first O characters, put together,
are the text. Limits that are null or not positive count as no limit; an overlap that is null or negative as 0, one of M or more
as M - 1. Texts within the limit (also empty ones) give no piece; null texts neither. Characters are Unicode code points.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NL = r"(?:\r\n|[\n\r\u0085\u2028\u2029])"
_WORD, _CLAUSE, _SENTENCE, _LINE, _BLOCK, _PART, _TOP = range(1, 8)
_COMMON = [
    (_WORD, r"[^\S\r\n]+|(?<=[\u3040-\u30ff\u3400-\u9fff])(?=[A-Za-z0-9])|(?<=[/_\-])(?=\w)"),
    (_CLAUSE, r"[,;:\u2013\u2014](?=\s)\s?|[\uff0c\u3001\uff1b\uff1a]"),
    (_SENTENCE, r"[.!?\u2026]+[\"'\u00bb\u201d\u2019)\]]*[^\S\r\n]+|[\u3002\uff01\uff1f]+[\u300d\u300f\u201d\u2019\uff09]*"),
    (_LINE, _NL),
    (_BLOCK, rf"{_NL}[^\S\r\n]*{_NL}(?:[^\S\r\n]*{_NL})*"),
]
_HEADS = rf"(?m){_NL}(?=\#{{1,6}}\s|={{2,6}}[^=\r\n]+={{2,6}}[^\S\r\n]*$|\\(?:sub)*section\*?\{{|[^\r\n]+{_NL}(?:={{3,}}|-{{3,}})[^\S\r\n]*$)"
_TAGS = r"(?i)</(?:p|div|section|article|table|ul|ol|pre|blockquote|h[1-6]|tr|li|item|entry|record|row)>\s*"
_SPECIAL: dict[str, list[tuple[int, str]]] = {
    "markdown": [(_PART, _HEADS)],
    "text": [(_PART, _HEADS)],
    "html": [(_BLOCK, _TAGS), (_PART, r"(?i)(?=<h[1-6][\s>])|</(?:section|article|table)>\s*"), (_PART, _HEADS)],
    "xml": [(_BLOCK, _TAGS), (_SENTENCE, r"</[^>]*>\s*")],
    "code": [(_BLOCK, rf"{_NL}(?=[^\s}})\]])"), (_PART, rf"{_NL}[^\S\r\n]*{_NL}(?=[^\s])"), (_TOP, rf"{_NL}(?=(?:def|class|func|function|fn|public|private|export|impl|struct|package|CREATE|create)\b|@)")],
    "csv": [(_TOP, _NL), (_CLAUSE, r"[,;|\t]")],
    "xlsx": [(_TOP, _NL), (_CLAUSE, r"[,;|\t]")],
    "json": [(_BLOCK, r"[}\]],?\s*"), (_SENTENCE, r",\s+")],
    "yaml": [(_TOP, rf"{_NL}(?=[^\s#\-])"), (_PART, rf"{_NL}(?=-\s|---)")],
    "pdf": [(_PART, r"\f")],
    "pptx": [(_PART, r"\f"), (_PART, _HEADS)],
    "docx": [(_PART, _HEADS)],
}
_COMPILED: dict[str, list] = {}


def _patterns(kind: str) -> list:
    if kind not in _COMPILED:
        _COMPILED[kind] = [(s, regex.compile(p)) for s, p in sorted([*_COMMON, *_SPECIAL.get(kind, [])])]
    return _COMPILED[kind]


def _glued(a: str, b: str) -> bool:
    """Whether a cut between a and b would break a character as read."""
    return (a == "\r" and b == "\n") or b == "\u200d" or a == "\u200d" or "\ufe00" <= b <= "\ufe0f" or "\U0001f3fb" <= b <= "\U0001f3ff" or bool(unicodedata.combining(b))


def boundaries(text: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, strengths), positions ascending and inside the text."""
    strength = np.zeros(len(text) + 1, np.uint8)
    for level, pattern in _patterns(kind or ""):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        strength[ends] = level
    strength[0] = strength[-1] = 0
    at = np.flatnonzero(strength)
    return at, strength[at]


def _place(text: str, at: np.ndarray, strength: np.ndarray, k: int, most: int, overlap: int, near: float) -> list[int] | None:
    """Ends of k pieces, or None if the last would be too long."""
    length = (len(text) + (k - 1) * overlap) / k
    ends: list[int] = []
    for i in range(k - 1):
        start = ends[-1] - overlap if ends else 0
        low = (ends[-1] if ends else overlap) + 1  # so that every piece starts after the one before
        high = min(start + most, len(text) - 1)
        if low > high:
            return None
        goal = min(max(round((i + 1) * length - i * overlap), low), high)
        reach = max(1, int(length * near))
        best = None
        for lo, hi in ((max(low, goal - reach), min(high, goal + reach)), (low, high)):
            a, b = np.searchsorted(at, lo), np.searchsorted(at, hi, side="right")
            if a < b:
                s = strength[a:b]
                top = np.flatnonzero(s == s.max())
                best = int(at[a + top[np.argmin(np.abs(at[a + top] - goal))]])
                break
        if best is None:
            best = goal
            while best > low and _glued(text[best - 1], text[best]):
                best -= 1
            if _glued(text[best - 1], text[best]):
                best = goal
        ends.append(best)
    start = ends[-1] - overlap if ends else 0
    return [*ends, len(text)] if len(text) - start <= most else None


def pieces(text: str, kind: str, most: int, overlap: int, near: float = 0.25) -> list[tuple[int, int]]:
    """(start, end) of each piece of a text with more than ``most`` characters; one piece for any other text."""
    n = len(text)
    if n <= most:
        return [(0, n)]
    overlap = min(max(0, overlap), most - 1)
    at, strength = boundaries(text, kind)
    k = 1 + math.ceil((n - most) / (most - overlap))
    ends = None
    while ends is None:
        ends = _place(text, at, strength, k, most, overlap, near)
        k += 1
        if ends is None and k > n:  # the limit leaves no room for a choice
            ends = [*range(most, n, most - overlap), n]
    return [(ends[i - 1] - overlap if i else 0, e) for i, e in enumerate(ends)]


def split_oversized(texts: DataFrame, limits: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, kind, piece_no, n_pieces, start, end, piece) of each text longer than its kind's limit; piece_no from 1.

    ``texts`` has key, kind and text, one row for each key; ``limits`` (kind, max_chars, overlap_chars) is a settings table.
    Only texts above their limit reach Python; nothing is shuffled for a settings table that Spark finds small.
    """
    lim = limits.filter("kind is not null and max_chars > 0").groupBy("kind").agg(F.min("max_chars").alias("most"), F.max(F.coalesce("overlap_chars", F.lit(0))).alias("over"))
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.join(lim, "kind").filter(F.length(text) > F.col("most")).select(key, "kind", text, "most", "over")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for i, what, t, most, over in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cut = pieces(t, what, most, over)
                for j, (s, e) in enumerate(cut, 1):
                    for o, v in zip(out, (i, what, j, len(cut), s, e, t[s:e]), strict=True):
                        o.append(v)
            kinds = [b.schema.field(0).type, pa.string(), *[pa.int32()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], [key, "kind", "piece_no", "n_pieces", "start", "end", "piece"])

    return rows.mapInArrow(run, f"`{key}` {kind}, kind string, piece_no int, n_pieces int, start int, end int, piece string")
