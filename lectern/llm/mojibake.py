"""Garbled text from wrong character encoding (problem 4).

Method: dictionary of garbled forms. The corpus' own vocabulary, with document frequencies, is counted: *words* (short runs of
letters with a non-ASCII character) and *pairs* of neighbouring non-ASCII characters, which stand for words where a script
writes none. Each word and each CJK pair is garbled under every chain (right encoding, wrong encoding, how often). A form that
occurs in the corpus, and less often than its original, is an entry of the table; frequencies count distinct texts, so that copies
say nothing. Documents are hash-joined against the table on their tokens; what was found is verified by decoding back and substituted.

A garbled form may be more common than its original. Where the right encoding writes several bytes a character, such a form stays in
the table as *exact*: it counts only where the passage decodes back without a gap, and the passage is long enough or a word of the
document decodes back to a word of the corpus under the same chain.

Lost bytes have entries too. Where a decoder put U+FFFD for bytes that it couldn't read, the token is the mark with its neighbours
(``n\ufffdv``), and the table holds what is left of each letter of the vocabulary in its neighbourhood (``aïv`` read as UTF-8); two marks
in a row are what is left of a word of two-byte letters. Such an entry tells that text was lost, and where the word isn't known the mark
stays.

A passage of non-ASCII characters is restored when pairs that are entries for one chain cover most of it and it decodes back under that
chain; a word when its entry decodes back to the frequent original. Lost bytes (U+FFFD) stay lost; the rest around them is
restored. The encoding column is not read.

Scale. The vocabulary is aggregated before it is shuffled. Two Bloom filters (over all data, no samples; 16 bits for each entry, built
block by block where the data lie) keep forms that no document has, and tokens that are no form, out of the joins. ``most_bits`` bounds what
is sent to the executors; beyond 2^24 entries the filters let more rows through to the joins, which give the same result. Only
documents with entries are read again for restoring.

Null texts are no case; empty and blank texts neither; repeated rows of a file count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize, spread

_SINGLE = "cp1252 cp1252w latin-1 cp437 cp850 mac_roman cp1250 cp1251 koi8-r cp866".split()
_MULTI = "gb18030 big5 euc-kr shift_jis euc-jp".split()
_CJK = "぀-ヿ㐀-鿿豈-﫿가-힯"
#: Bytes that no decoder could read: a mark between letters or at the end of a word, or several in a row.
_LOST = re.compile("�{2}|(?<![^\\W\\d_])�(?=[a-z])|(?<=[^\\W\\d_])�(?![�])")
#: A character inside a word that is no letter of its script: the garbled form of one letter, or of a letter and the next.
_INSIDE = re.compile(rf"(?<=[a-z])([^\x00-\x7f\xad\u2019\u00b7\w])(?=[a-z])|(?<=[A-Za-z])([{_CJK}])(?=[a-z])")
_BOXES = re.compile("[\u2500-\u257f]+")
_CYRILLIC = re.compile("[\u0400-\u04ff]+")
_RIGHT_WORD = "utf-8 cp1252 cp1250 cp1251 koi8-r cp866 mac_roman cp850".split()
_RIGHT_CJK = "utf-8 gb18030 big5 shift_jis euc-jp".split()
_IS_CJK = re.compile(f"[{_CJK}]")
#: Spaces and CJK or full-width punctuation end a word.
_WORD = re.compile("[A-Za-z\u0080-῿‐-‧‰-⿿぀-﻿｡-\U0010ffff]+")
_HIGH = re.compile("[^\x00-\x7f]+")
_LETTERS = re.compile(r"[^\W\d_]+")


@cache
def _web() -> tuple[str, dict[int, int]]:
    """cp1252 whose undefined bytes are control characters."""
    table = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
    return table, {ord(c): b for b, c in enumerate(table)}


def _to_bytes(text: str, codec: str) -> bytes | None:
    if codec == "cp1252w":
        try:
            return bytes(_web()[1][ord(c)] for c in text)
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeError:
        return None


def _to_text(raw: bytes, codec: str, errors: str = "replace") -> str | None:
    if codec == "cp1252w":
        return "".join(_web()[0][b] for b in raw)
    try:
        return raw.decode(codec, errors)
    except UnicodeError:
        return None


@cache
def chains(cjk: bool) -> tuple[tuple[str, str, int], ...]:
    """(right, wrong, times) of all encoding mistakes considered."""
    rights = _RIGHT_CJK if cjk else _RIGHT_WORD
    once = [(r, w, 1) for r in rights for w in [*_SINGLE, *_MULTI, *(() if cjk else ("utf-8",))] if r != w and not (r == "cp1252" and w in ("cp1252w", "latin-1"))]
    return (*once, *(("utf-8", w, 2) for w in _SINGLE))


def garble(text: str, chain: tuple[str, str, int]) -> str | None:
    right, wrong, times = chain
    for _ in range(times):
        raw = _to_bytes(text, right)
        if raw is None:
            return None
        text = _to_text(raw, wrong)
    return text


def restore(text: str, chain: tuple[str, str, int], errors: str = "strict") -> str | None:
    right, wrong, times = chain
    for _ in range(times):
        raw = _to_bytes(text, wrong)
        text = None if raw is None else _to_text(raw, right, errors)
        if text is None:
            return None
    return text


def _tokens(text: str) -> set[str]:
    """Words and pairs of a text."""
    out: set[str] = set()
    for run in _HIGH.findall(text):
        if len(run) > 1:
            out.update(map("".join, zip(run[:-1], run[1:], strict=True)))
    if out or not text.isascii():
        for w in _WORD.findall(text):
            if not w.isascii() and (len(w) < 4 or len(_IS_CJK.findall(w)) < 4):
                out.add("w" + w)
        out.update("c" + (a or b) for a, b in _INSIDE.findall(text))
        if "�" in text:
            out.update("l" + x for x in _lost(text))
    return out


def _letter(c: str) -> str:
    """A neighbour: the letter itself, or a blank for the edge of a word."""
    return c.lower() if c.isalpha() and not _IS_CJK.match(c) else " "


def _lost(text: str) -> Iterator[str]:
    """Marks of lost bytes with their neighbours."""
    for m in _LOST.finditer(text):
        s = m.start()
        yield "��" if len(m[0]) > 1 else _letter(text[s - 1 : s]) + "�" + _letter(text[s + 1 : s + 2])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["tok", "df"])
        seen.clear()
        return b

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text.isascii():
                seen.update(_tokens(text))
                seen.update(set("".join(_HIGH.findall(text))))  # the characters, for their own frequency
        if len(seen) > 1_000_000:
            yield out()
    yield out()


class Filter:
    """A Bloom filter over all rows of a string column, in blocks of 2^16 bits: the blocks are built where their rows lie and united on
    the driver, ``bits`` in all."""

    BLOCK = 1 << 16

    def __init__(self, rows: DataFrame, most_bits: int):
        count = rows.count()
        n = 16
        while 1 << n < min(16 * count, 1 << most_bits):
            n += 1
        blocks = (1 << n) // self.BLOCK

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = Filter.hashes(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(blocks)).astype(np.int32)), pa.array((h >> np.uint64(16)).view(np.int64))], ["block", "h"])

        def build(table: pa.Table) -> pa.Table:
            own = np.zeros(Filter.BLOCK, bool)
            for at in Filter.places(table.column("h").to_numpy().astype(np.uint64)):
                own[at] = True
            return pa.Table.from_arrays([table.column("block").slice(0, 1), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["block", "bits"])

        all_bits = np.zeros((blocks, self.BLOCK // 8), np.uint8)
        for r in rows.mapInArrow(route, "block int, h long").groupBy("block").applyInArrow(build, "block int, bits binary").toLocalIterator():
            all_bits[r[0]] = np.frombuffer(r[1], np.uint8)
        self.blocks, self.shared = blocks, rows.sparkSession.sparkContext.broadcast(all_bits.tobytes())  # at most 2^most_bits bits

    @staticmethod
    def hashes(tokens: list[str]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens))

    @staticmethod
    def places(h: np.ndarray) -> list[np.ndarray]:
        """Places inside a block, from the upper 48 bits of a hash."""
        return [((h >> np.uint64(s)) % np.uint64(Filter.BLOCK)).astype(np.int64) for s in (0, 16, 32)]

    def keep(self, tokens: list[str]) -> np.ndarray:
        """Which of the tokens may be in the column."""
        bits = np.frombuffer(self.shared.value, np.uint8)
        h = self.hashes(tokens)
        first = (h % np.uint64(self.blocks)).astype(np.int64) * self.BLOCK
        ok = np.ones(len(tokens), bool)
        for place in self.places(h >> np.uint64(16)):
            at = first + place
            ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return ok


def _pairs(form: str) -> list[str]:
    return [form[i : i + 2] for i in range(len(form) - 1) if form[i] > "\x7f" and form[i + 1] > "\x7f"]


def _forms_of(tok: str) -> Iterator[tuple[str, str, tuple[str, str, int]]]:
    """(key, original, chain) of a word or pair."""
    if tok[0] == "w" and len(tok) > 1 and tok[1:].isascii() is False:
        word = tok[1:]
        if _IS_CJK.search(word) or not _LETTERS.search(word):
            return
        if any(len(c.encode()) > 1 and c.isalpha() for c in word):
            # what is left of a letter between its neighbours, and of two letters of two bytes each
            for i, c in enumerate(word):
                if c > "\x7f" and c.isalpha():
                    yield "l" + _letter(word[i - 1 : i]) + "�" + _letter(word[i + 1 : i + 2]), word, ("cp1252" if c < "\u0250" else "cp1251", "utf-8", 1)
                    if word[i + 1 : i + 2] > "\x7f":
                        yield "l��", word, ("cp1251", "utf-8", 1)
        for chain in chains(False):
            form = garble(word + " ", chain)
            if form and form.endswith(" ") and (form := form[:-1]) != word and not form.isascii() and _WORD.fullmatch(form):
                if chain[1] == "utf-8" and "�" not in form:  # valid sequences: the word is the garbled form of this one
                    continue
                if len(form) > 2 and len(word) > 2 and form.count("�") <= min(2, len(form) - 2) and _LETTERS.fullmatch(word.replace("\u2019", "")):
                    yield "w" + form, word, chain
    elif len(tok) == 2 and _IS_CJK.match(tok) and _IS_CJK.match(tok[1]):
        yield "l��", tok, ("gb18030", "utf-8", 1)
        for chain in chains(True):
            right, wrong, _ = chain
            if wrong in _MULTI:  # two bytes meet in a character: both alignments
                raw = _to_bytes(tok, right)
                for lead in (0, 1):
                    form = raw and _to_text(raw[lead:], wrong, "replace")
                    for p in _pairs(form or ""):
                        if "�" not in p:
                            yield p, tok, chain


def _forms_of_char(c: str) -> Iterator[tuple[str, str, tuple[str, str, int]]]:
    """Pairs inside the garbled forms of one character, for wrong encodings that give each byte a character; and the forms of a
    letter that are one character but no letter, to be met inside words."""
    if c.isalpha() and not _IS_CJK.match(c):
        for chain in chains(False):
            if chain[0] in _SINGLE and chain[1] in _SINGLE and (form := garble(c, chain)) and len(form) == 1 and form != "�" and _INSIDE.search("a" + form + "a"):
                yield "c" + form, c, chain
        for right in ("cp1252", "cp1250"):
            for wrong in _MULTI:
                for x in "abcdefghijklmnopqrstuvwxyz":
                    if (form := garble(c + x, (right, wrong, 1))) and len(form) == 1 and _IS_CJK.match(form):
                        yield "c" + form, c + x, (right, wrong, 1)
    for chain in dict.fromkeys([*chains(True), *chains(False)]) if _IS_CJK.match(c) or not c.isalpha() else chains(False):
        if chain[1] in _SINGLE and (form := garble(c, chain)) and form != c:
            for p in _pairs(form):
                if p != "��":
                    yield p, c, chain
    if not _IS_CJK.match(c):
        for wrong in _MULTI:
            if (form := garble(c, ("utf-8", wrong, 1))) and form != c:
                for p in _pairs(form):
                    if "�" not in p:
                        yield p, c, ("utf-8", wrong, 1)


def _name(chain: tuple[str, str, int]) -> str:
    return "|".join(map(str, chain))


def _chain(name: str) -> tuple[str, str, int]:
    r, w, n = name.split("|")
    return r, w, int(n)


def _exact(key: str, orig: str, chain: tuple[str, str, int]) -> bool:
    """Whether the bytes themselves can prove the form: a word that decodes back, or a pair of sequences of several bytes."""
    if key[0] == "l":  # a mark is no letter, however often it stands
        return True
    if key[0] == "w":
        return chain[0] == "utf-8" and restore(key[1:], chain) == orig
    # between two encodings of two bytes a character nearly every text is valid both ways, so that their bytes prove nothing
    return key[0] > "\x7f" and (chain[0] == "utf-8" or chain[0] in _RIGHT_CJK and chain[1] in _SINGLE and not _CYRILLIC.search(key))


def _generate(keep: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tok, df, char in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(k, o, _name(c), df) for k, o, c in (_forms_of_char(tok) if char else _forms_of(tok))]
            if rows:
                ok = keep.keep([r[0] for r in rows])
                rows = [r for r, good in zip(rows, ok.tolist(), strict=True) if good]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            exact = [_exact(k, o, _chain(c)) for k, o, c, _ in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64()), pa.array(exact, pa.bool_())], ["tok", "orig", "chain", "odf", "exact"])

    return run


def _match(keep: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, toks = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text.isascii():
                    own = list(_tokens(text))
                    ids += [i] * len(own)
                    toks += own
            ok = keep.keep(toks)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).filter(pa.array(ok)), pa.array(toks, pa.string()).filter(pa.array(ok))], ["id", "tok"])

    return run


def _back(run: str, chain: tuple[str, str, int]) -> str | None:
    """A passage decoded back; characters at its ends that belong to half a sequence are kept out; U+FFFD stays."""
    full = restore(run, chain)
    if full is not None:
        return full
    out, good = [], 0
    for piece in re.split("(�+)", run):
        if not piece or piece[0] == "�":
            out.append(piece)
            continue
        text = restore(piece, chain, "replace")
        if text is None:
            return None
        text = text.strip("�") if "�" in run or chain[1] in _MULTI else text
        good += len(text.replace("�", ""))
        out.append(text)
    text = "".join(out)
    return text if good and text.count("�") <= max(2, good, run.count("�")) else None


def _covered(run: str, known: set[str]) -> int:
    """Characters of a passage that lie in a known pair. Two-byte encodings know no pair across characters."""
    covered, last = 0, -1
    for i in range(len(run) - 1):
        if run[i : i + 2] in known:
            covered += 2 if last < i else 1
            last = i + 1
    return covered


def _weight(run: str, chain: tuple[str, str, int]) -> float:
    """How much a decoded passage tells: UTF-8 sequences are hard to meet by chance, two letters of another script are not."""
    return (len(run) - 1) * (1.0 if chain[0] == "utf-8" else 0.3)


Hits = tuple[set[str], dict[str, tuple[int, str]], set[str], dict[str, tuple[int, str]]]


def repair(text: str, hits: dict[str, Hits], least: float = 0.6, enough: float = 1.0) -> tuple[str, float, int]:
    """(restored text, weight of restored passages, restored words). hits: for each chain its pairs and its words with (document
    frequency, original), and the same of the exact entries. Where all passages together weigh less than ``enough``, they stay as they are."""
    order = sorted(hits, key=lambda c: (-len(hits[c][0]), -len(hits[c][1]), -len(hits[c][2]), c))
    best: dict[str, tuple[int, str]] = {}
    for _, own, _, _ in hits.values():
        for w, o in own.items():
            best[w] = max(o, best.get(w, (0, "")))
    proof: dict[str, tuple[int, str]] = {}
    for _, _, _, own in hits.values():
        for w, o in own.items():
            proof[w] = max(o, proof.get(w, (0, "")))
    best = proof | best
    confirmed = {name for name, (_, sure, _, exact) in hits.items() if exact or any(_chain(name)[0] == "utf-8" and restore(w, _chain(name)) == o for w, (_, o) in sure.items())}
    weight: Counter = Counter()
    words = 0
    with_pair: dict[str, list[int]] = {}  # the chains, by their place in the order, that know a pair
    for i, name in enumerate(order):
        for p in hits[name][0] | hits[name][2]:
            with_pair.setdefault(p, []).append(i)

    def near(run: str) -> list[str]:
        """The chains that know some pair of a passage, in their order: no other covers a part of it."""
        own: set[int] = set()
        for i in range(len(run) - 1):
            own.update(with_pair.get(run[i : i + 2], ()))
        return [order[i] for i in sorted(own)]

    def proves(run: str, new: str, name: str, chain: tuple[str, str, int]) -> bool:
        """Whether the bytes of a passage suffice, however common its pairs are."""
        if new.count("�") > run.count("�"):
            return False
        if _CYRILLIC.fullmatch(run) and run not in hits[name][1] and run not in hits[name][3]:  # a word whose bytes happen to be valid
            return False
        if chain[0] != "utf-8" and (_CYRILLIC.search(run) or _covered(run, hits[name][0] | hits[name][2]) < len(run)):
            return False
        following = len(_to_bytes(new.replace("�", ""), chain[0]) or b"") - len(new.replace("�", ""))
        return name in confirmed or following >= 3

    def attempt(run: str, name: str, share: float) -> str | None:
        known, _, more, _ = hits[name]
        proved = not known or _covered(run, known) < share * len(run)
        if proved and (not more or _covered(run, known | more) < share * len(run)):
            return None
        chain = _chain(name)
        if chain[0] in _RIGHT_CJK[1:] and (_CYRILLIC.fullmatch(run) or run in best and _CYRILLIC.fullmatch(best[run][1])):  # letters of one alphabet read as a word, not as bytes
            return None
        new = _back(run, chain)
        if new is None or new == run or not (len(new) < len(run) or chain[1] in _MULTI):
            return None
        if chain[0] in _RIGHT_CJK[1:] and _BOXES.fullmatch(new):  # no text
            return None
        if proved and not proves(run, new, name, chain):
            return None
        weight[name] += _weight(run, chain)
        return new

    def passage(m: re.Match) -> str:
        run = m[0]
        if len(run) < 2:
            return run
        return next((new for name in near(run) if (new := attempt(run, name, least)) is not None), run)

    def again(m: re.Match) -> str:
        run = m[0]
        for name in [n for n in near(run) if n in sure] if len(run) > 3 else []:
            if (new := attempt(run, name, 0.25)) is not None and "�" not in new:
                return new
        return run

    def word(m: re.Match) -> str:
        nonlocal words
        if m[0] in best and not _INSIDE.fullmatch(m[0][1:]):
            words += 1
            return best[m[0]][1]
        return m[0]

    old = text
    text = _HIGH.sub(passage, text)
    if sum(weight.values()) < enough:
        text = old
        weight.clear()
    sure = [n for n in order if weight[n] >= 3]
    if sure:
        text = _HIGH.sub(again, text)
    text = _WORD.sub(word, text)
    if inside := {t[1:]: (odf, o) for t, (odf, o) in best.items() if t[0] == "c" and len(t) == 2}:
        text = _INSIDE.sub(lambda m: inside.get(m[0], (0, m[0]))[1], text)
        words += 1
    return text, sum(weight.values()), words


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
            hits: dict = {}
            gone = False  # a mark of lost bytes met the table
            for h in found:
                sure = hits.setdefault(h["chain"], (set(), {}, set(), {}))
                pairs, words = sure[:2] if h["sure"] else sure[2:]
                if h["tok"][0] == "l":
                    gone = True
                elif h["tok"][0] == "c":
                    words[h["tok"]] = (h["odf"], h["orig"])
                elif h["word"]:
                    words[h["tok"][1:]] = (h["odf"], h["orig"])
                else:
                    pairs.add(h["tok"])
            new, weight, words = repair(text, {c: v for c, v in hits.items() if any(v)})
            if weight or words or gone:
                rows.append((i, new, weight, words, new.count("�")))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "restored", "weight", "words", "lost"])


class Garbled:
    """Affected records of ``records`` (id long, text) with their restored text: ``restored()``."""

    def __init__(self, records: DataFrame, most_bits: int = 28):
        key, text = records.columns[:2]
        self.records = records.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
        distinct = self.records.select("text").filter("length(text) < octet_length(text)").distinct()  # copies count once
        vocabulary = distinct.mapInArrow(_count, "tok string, df long").groupBy("tok").agg(F.sum("df").alias("df"))
        self.vocabulary = materialize(vocabulary, "vocabulary")
        has = Filter(self.vocabulary.select("tok"), most_bits)
        source = self.vocabulary.select("tok", "df", (F.length("tok") == 1).alias("char"))
        kind = F.length("orig") > 1
        word = kind & F.col("tok").startswith("w") & (F.length("tok") > 2) & ~F.col("orig").rlike(f"[{_CJK}]")
        forms = spread(source).mapInArrow(_generate(has), "tok string, orig string, chain string, odf long, exact boolean")
        forms = forms.groupBy("tok", "chain").agg(F.max(F.struct("odf", "orig", "exact")).alias("top")).select("tok", "chain", "top.orig", "top.odf", "top.exact", word.alias("word"))
        # an original that is itself a garbled form of a more frequent word is not clean
        enough = (F.col("odf") >= F.when(F.col("word"), 3).otherwise(2) * F.col("df")) & (~F.col("word") | (F.col("odf") >= 3))
        forms = materialize(forms.join(self.vocabulary, "tok").withColumn("sure", enough).filter("sure or exact"), "forms")
        dirty = forms.filter("word").select(F.expr("substring(tok, 2)").alias("orig")).distinct()
        self.table = materialize(forms.filter("word").join(dirty, "orig", "left_anti").select(forms.columns).union(forms.filter("not word")), "table")
        self.bits = most_bits

    def hits(self) -> DataFrame:
        """(id, tok, chain, orig, odf, word, sure): the entries of the table that a record has."""
        keep = Filter(self.table.select("tok").distinct(), self.bits)
        return self.records.mapInArrow(_match(keep), "id long, tok string").join(self.table, "tok")

    def restored(self) -> DataFrame:
        """(id, restored, weight, words, lost): lost counts the characters that stay U+FFFD."""
        found = self.hits().groupBy("id").agg(F.collect_list(F.struct("tok", "chain", "orig", "odf", "word", "sure")).alias("found"))
        some = self.records.join(found, "id")
        return some.select("id", "text", "found").mapInArrow(_restored, "id long, restored string, weight double, words int, lost int")
