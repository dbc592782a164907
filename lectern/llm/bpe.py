"""Encoding with a public byte-level BPE vocabulary (problem 6), vectorised over all texts of a partition.

Method: pair occurrence index. The distinct words of a partition lie in one array of symbols, linked to their neighbours. An
index maps each mergeable pair to all its positions. The active ranks are applied in ascending order, each to all its positions
at once; a merge changes only the index lists of the pairs left and right of it. A symbol made by a merge occurs only in pairs
of higher rank, so no rank becomes active again.

Null and empty texts have the empty list. Special tokens are ordinary text. Vocabularies are read from a path, never trained.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shingles import _powers, code_points, mix

#: Where the public vocabulary lies on the driver's machine; a parameter of all functions.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_SPACE, _LETTER, _NUMBER, _OTHER, _EDGE = range(5)
_EDGE_CP = 0x110000  # stands between texts, no code point


@cache
def _classes() -> np.ndarray:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110001, _OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for run in regex.findall(pattern, every):
            out[code_points(run)] = c
    out[_EDGE_CP] = _EDGE
    return out


class Vocabulary:
    """Byte symbols, and merges as sorted keys with rank and result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        # the byte alphabet: printable bytes stand for themselves, the others follow from U+0100
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = ([vocab[p[i]] for p in pairs] for i in (0, 1))
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = self.left.astype(np.int64) * self.size + self.right
        self.order = np.argsort(key)
        self.keys = key[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def split(cps: np.ndarray) -> np.ndarray:
    """Starts of the words of an array of code points in which _EDGE_CP parts texts; an edge is a word of its own.

    The words are those of the vocabulary's published pattern: contractions, runs of letters, of numbers and of other characters,
    each with one space before it, and runs of white space.
    """
    cls = _classes()[cps]
    n = len(cls)
    start = np.ones(n, bool)
    start[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _EDGE)
    nxt = np.full(n, _EDGE, np.uint8)
    nxt[:-1] = cls[1:]
    last = (cls == _SPACE) & (nxt != _SPACE) & (nxt != _EDGE)  # the last of a white-space run before a word
    start |= last
    joins = np.flatnonzero(last & (cps == 0x20)) + 1
    start[joins] = False
    # contractions: an apostrophe that starts a word, with letters after it
    at = np.flatnonzero((cps == 0x27) & start & (nxt == _LETTER))
    if len(at):
        pad = np.concatenate([cps, np.full(3, _EDGE_CP, cps.dtype)])
        one, two = pad[at + 1], pad[at + 2]
        short = np.isin(one, [ord(c) for c in "sdmt"])
        long = np.zeros(len(at), bool)
        for a, b in ("ll", "ve", "re"):
            long |= (one == ord(a)) & (two == ord(b))
        for hit, size in ((at[short], 2), (at[long & ~short], 3)):
            start[hit + 1] = False
            after = hit + size
            after = after[after < n]
            start[after] = True
    return np.flatnonzero(start)


def merge(symbols: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Apply all merges to an array of symbols with -1 between words; returns the array with -2 for what was merged away."""
    sym = symbols.astype(np.int32)
    n = len(sym)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray, rank: np.ndarray) -> None:
        keep = rank >= 0
        at, rank = at[keep], rank[keep]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        lo = 0
        for hi in [*cuts.tolist(), len(at)]:
            r = int(rank[lo])
            if r in index:
                index[r].append(at[lo:hi])
            else:
                index[r] = [at[lo:hi]]
                heapq.heappush(active, r)
            lo = hi

    first = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
    add(first, vocab.ranks(sym[first], sym[first + 1]))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        a, b, c = vocab.left[r], vocab.right[r], vocab.made[r]
        at = np.concatenate(lists) if len(lists) > 1 else lists[0]
        at = at[sym[at] == a]
        at = at[sym[nxt[at]] == b]
        if not len(at):
            continue
        if len(lists) > 1 or a == b:
            at = np.unique(at)
        if a == b and len(at) > 1:  # of overlapping places every second one, from the left of each chain
            chained = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
            head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = c
        sym[gone] = -2
        nxt[at] = after
        prv[after] = at
        before = prv[at]
        right = at[sym[after] >= 0]
        left = before[sym[before] >= 0]
        if len(left) or len(right):
            both = np.concatenate([left, right])
            add(both, vocab.ranks(sym[both], sym[nxt[both]]))
    return sym


def _encode_words(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, end of each word's ids)."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(size)
    # one edge before each word and one at the end
    sym = np.full(len(flat) + len(raw) + 1, -1, np.int32)
    sym[np.arange(len(flat)) + np.repeat(np.arange(1, len(raw) + 1), size)] = vocab.byte[flat]
    sym = merge(sym, vocab)
    alive = np.cumsum(sym >= 0)
    return sym[sym >= 0], alive[ends + np.arange(len(raw))]


def _same(cps: np.ndarray, start: np.ndarray, size: np.ndarray, twin: np.ndarray) -> bool:
    """Whether each word is, character for character, the one at ``twin``."""
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return bool((cps[np.repeat(start, size) + offset] == cps[np.repeat(twin, size) + offset]).all())


def encode(texts: list[str | None], path: str = VOCABULARY, count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each text). With count_only the ids are left out."""
    vocab = vocabulary(path)
    if not texts:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    edge = np.full(1, _EDGE_CP, np.uint32)
    parts = [x for t in texts for x in (code_points(t or ""), edge)]
    cps = np.concatenate(parts)
    text_end = np.cumsum([len(p) for p in parts])[1::2]
    start = split(cps)
    size = np.diff(np.append(start, len(cps)))
    word = cps[start] != _EDGE_CP
    doc = np.searchsorted(text_end, start, side="right")[word]
    start, size = start[word], size[word]
    if not len(start):
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    up, down = _powers(max(10, int(len(cps)).bit_length()))
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * up[: len(cps)], out=sums[1:])
    hashes = mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    if not (np.array_equal(size, size[first][which]) and _same(cps, start, size, start[first][which])):
        half = len(texts) // 2  # two words with one hash: they part, or the pieces get small enough
        if half == 0:
            first, which = np.arange(len(start)), np.arange(len(start))
        else:
            a, b = encode(texts[:half], path, count_only), encode(texts[half:], path, count_only)
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    words = [cps[s : s + z].tobytes().decode("utf-32-le", "surrogatepass") for s, z in zip(start[first].tolist(), size[first].tolist(), strict=True)]
    ids, ends = _encode_words(words, vocab)
    length = np.diff(ends, prepend=0)
    each = length[which]
    count = np.bincount(doc, each, len(texts)).astype(np.int64)
    if count_only:
        return np.empty(0, np.int32), count
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat((ends - length)[which], each)
    return ids[at], count


def _chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.Array, list]]:
    """Key column and texts, in groups of about ``chars`` characters."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            keys.append(part.column(0))
            texts += (new := part.column(1).to_pylist())
            size += sum(len(t) for t in new if t)
            if size >= chars:
                yield pa.concat_arrays(keys), texts
                keys, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(keys), texts


def _ship(docs: DataFrame, path: str) -> str:
    """Sends the vocabulary file with the job; the name under which the executors find it."""
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def token_ids(docs: DataFrame, key: str, text: str, path: str = VOCABULARY, chunk_chars: int = 4_000_000) -> DataFrame:
    """(key, ids array<int>): each row's text encoded; the empty list for null and empty texts. Rows aren't merged or dropped;
    other columns of ``docs`` don't matter. No shuffle."""
    kind, name = docs.schema[key].dataType.simpleString(), _ship(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _chunks(batches, chunk_chars):
            ids, count = encode(texts, SparkFiles.get(name))
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
            for lo in range(0, len(keys), 2000):
                yield pa.RecordBatch.from_arrays([keys.slice(lo, 2000), lists.slice(lo, 2000)], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, keys: list[str], text: str, path: str = VOCABULARY, chunk_chars: int = 4_000_000) -> DataFrame:
    """The key columns and n_tokens (long): 0 for null and empty texts."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    name = _ship(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts in _chunks(batches, chunk_chars):
            _, count = encode(texts, SparkFiles.get(name), count_only=True)
            yield pa.RecordBatch.from_arrays([*key.flatten(), pa.array(count, pa.int64())], [*keys, "n_tokens"])

    return docs.select(F.struct(*keys).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"{kinds}, n_tokens long")
