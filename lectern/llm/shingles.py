"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once with numpy.

Tokens are each single character in U+3040-U+30FF or U+3400-U+9FFF and, elsewhere, each longest run of letters and digits
(Unicode classes L and N) of the lower-cased text. A shingle is a run of five consecutive tokens.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

WORDS = 5
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 2**64))


@cache
def _classes() -> np.ndarray:
    """For each code point: 0 separator, 1 part of a run, 2 token of its own."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LN":
            out[c] = 1
    out[0x3040:0x3100] = 2
    out[0x3400:0xA000] = 2
    return out


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _B), np.full(n, _BINV)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def token_hashes(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start position and hash of each token of a lower-cased array of code points."""
    if not len(cps):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    cls = _classes()[cps]
    before = np.empty_like(cls)
    before[0], before[1:] = 0, cls[:-1]
    after = np.empty_like(cls)
    after[-1], after[:-1] = 0, cls[1:]
    start = np.flatnonzero((cls == 2) | ((cls == 1) & (before != 1)))
    end = np.flatnonzero((cls == 2) | ((cls == 1) & (after != 1))) + 1
    up, down = _powers(max(10, int(len(cps)).bit_length()))
    sums = np.empty(len(cps) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * up[: len(cps)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[str], words: int = WORDS, chars: int = 4_000_000) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty where a text has fewer tokens than a shingle."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < chars):
            group.append(code_points(texts[at].lower()))
            size += len(group[-1])
            at += 1
        gap = np.full(1, 0x20, np.uint32)
        parts = [x for g in group for x in (g, gap)]
        cps = np.concatenate(parts)
        edges = np.cumsum([len(g) + 1 for g in group])
        start, tok = token_hashes(cps)
        bounds = np.searchsorted(start, edges)  # tokens of text i end at bounds[i]
        shingle = np.zeros(max(0, len(tok) - words + 1), np.uint64)
        for k in range(words):
            shingle += mix(tok[k : k + len(shingle)] + np.uint64((k * 0x632BE59BD9B4E019) % 2**64))
            shingle *= _B
        shingle = mix(shingle)
        lo = 0
        for hi in bounds.tolist():
            out.append(np.unique(shingle[lo : max(lo, hi - words + 1)]))
            lo = hi
    return out
