"""Long exact spans shared between records (problem 8).

A character is shared if it lies in a window of ``window`` consecutive characters that occurs, character for character, in
another record too. Method: log-structured fingerprint index. Each batch of records becomes one immutable *run*: a table of its
fingerprints, bucketed and sorted, with the least and greatest record that has each. A new run is merge-joined with every older run,
bucket by bucket and without a shuffle; when ``fanout`` runs have gathered they are compacted into one. Runs and places lie in a
folder with a log of commits, so that a later session goes on where an earlier one ended; what no commit names was never added.

Fingerprints. Every window holds window - gram + 1 grams; its anchor is the least of their hashes, which depends on the window's
text alone. Consecutive windows with one anchor form a segment (about (window - gram) / 2 windows, at most window - gram + 1), whose
*place* is kept: anchor, hash of the segment's whole text, record, start, number of windows. Windows with equal text have equal anchors, so
only anchors met in two records matter.

Verification. Segments with equal (anchor, text hash) in two records are shared whole; the text hash covers all of a segment and the
anchor a part of it, by different bases. Where one anchor has different segments (the edges of shared passages) all windows of one
segment of each kind are compared by two 64-bit hashes of their whole text.

Skew. Fingerprints are combined before they are shuffled, and places aren't shuffled by anchor until only met anchors are left. Joins back
to the places take very frequent keys, at most ``HOT_MOST`` by their definition, by broadcast. Nothing is paired: a passage in a third of
all records costs rows in proportion, and only minima and maxima of record ids are kept for a fingerprint.

Null ids and null texts are no records; texts shorter than a window have no span; rows that repeat a record's id are the same
record, so text repeated inside one record is not shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.commits import CommitLog
from lectern.llm.shingles import code_points, mix
from lectern.session import hash_ranges, materialize, remove, scratch

#: The most keys of a join that can count as very frequent: such a key has at least one in this many of all rows.
HOT_MOST = 50_000
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_MULT = np.uint64(0x9FB21C651E98DF25)


@cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, np.uint64(base)), np.full(1 << bits, np.uint64(pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Hash:
    """Hashes of any substring of one array of code points."""

    def __init__(self, cps: np.ndarray, base: int):
        up, self.down = _powers(base, max(10, int(len(cps)).bit_length()))
        self.sums = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * _MULT * up[: len(cps)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _chunks(batches: Iterator[pa.RecordBatch], chars: int):
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= chars:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def segments(texts: list[str], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, start, number of windows, anchor, hash of the segment's text) of each segment."""
    parts = [code_points(t) for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    cps = np.concatenate(parts)
    end = np.cumsum(size)
    if len(cps) < window:
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    first = _Hash(cps, _BASES[0])
    at = np.arange(len(cps) - gram + 1)
    anchor = _least(first.of(at, at + gram), window - gram + 1)
    owner = np.repeat(np.arange(len(parts)), size)[: len(anchor)]
    good = at[: len(anchor)] + window <= end[owner]
    new = good.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | ~good[:-1]
    # repetitive text has one anchor for long: cut it, so that its pieces are equal
    first_of = np.maximum.accumulate(np.where(new, at[: len(anchor)], 0))
    new |= good & ((at[: len(anchor)] - first_of) % (window - gram + 1) == 0)
    start = np.flatnonzero(new)
    count = np.add.reduceat(good, start, dtype=np.int64) if len(start) else np.empty(0, np.int64)
    text = _Hash(cps, _BASES[1]).of(start, start + count + window - 1)
    who = owner[start]
    return who, start - (end - size)[who], count, anchor[start], text


def _segments(window: int, gram: int, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches, chars):
            who, start, count, anchor, text = segments(texts, window, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(text.view(np.int64)), pa.array(ids[who]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                ["anchor", "seg", "doc", "start", "n"],
            )

    return run


def _windows(window: int):
    """Hashes of all windows of the listed segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for doc, text, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                cps = code_points(text)
                one, two = _Hash(cps, _BASES[0]), _Hash(cps, _BASES[1])
                for s in segs:
                    at = np.arange(s["start"], s["start"] + s["n"])
                    for o, v in zip(out, (one.of(at, at + window).view(np.int64), two.of(at, at + window).view(np.int64), np.full(len(at), s["lo"]), np.full(len(at), s["hi"]), np.full(len(at), doc), at), strict=True):
                        o.append(v)
            cols = [pa.array(np.concatenate(o).astype(np.int64) if o else np.empty(0, np.int64)) for o in out]
            cols[5] = cols[5].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(cols, ["w1", "w2", "lo", "hi", "doc", "at"])

    return run


def _join_back(rows: DataFrame, kinds: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``kinds`` (one row for each key, with its number ``k`` of rows). Keys with very many rows are joined by broadcast,
    so that no task gets all rows of one."""
    total, most = kinds.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    least = max(10_000, total // HOT_MOST)
    if most < least:
        return rows.join(kinds.drop("k"), on, how)
    hot = kinds.filter(F.col("k") >= least)  # at most HOT_MOST rows
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot.drop("k")), on, how).unionByName(rest.join(kinds.drop("k"), on, how))


class FingerprintIndex:
    """An index in the folder ``root`` that grows by batches of records (id, text) with disjoint ids.

    ``add`` indexes a batch, ``new_spans`` gives the spans that the records of the last batch share with it and all before, ``spans``
    those of all records.
    """

    PLACE = "anchor long, seg long, doc long, start int, n int"
    RUN = "anchor long, lo long, hi long"

    def __init__(self, spark: SparkSession, root: str | None = None, window: int = 200, gram: int = 100, fanout: int = 4, chunk_chars: int = 2_000_000, buckets: int | None = None):
        self.spark, self.window, self.gram, self.fanout, self.chars = spark, window, gram, fanout, chunk_chars
        self.root = (root or scratch(spark, "spans")).rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/commits")
        done = self.log.entries()
        self.state = done[-1] if done else {"number": 0, "runs": [], "places": [], "met": [], "buckets": buckets, "window": window, "gram": gram}
        if (self.state["window"], self.state["gram"]) != (window, gram):
            raise ValueError("the index was made with another window or gram")

    def _write(self, rows: DataFrame, name: str) -> None:
        """A run: bucketed and sorted by anchor."""
        n = self.state["buckets"]
        (
            rows.repartition(n, "anchor").write.bucketBy(n, "anchor").sortBy("anchor").format("parquet").mode("overwrite")
            .option("compression", "zstd").option("path", f"{self.root}/{name}").saveAsTable(self._name(name))
        )

    def _name(self, name: str) -> str:
        return f"lectern_{name}_{hashlib.md5(self.root.encode()).hexdigest()}"

    def _run(self, name: str) -> DataFrame:
        """The table of a run, made known to this session's catalogue if another session wrote it."""
        table = self._name(name)
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"create table {table} ({self.RUN}) using parquet clustered by (anchor) sorted by (anchor) into {self.state['buckets']} buckets location '{self.root}/{name}'")
        return self.spark.table(table)

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs merge-joined: buckets of one anchor range meet, already sorted."""
        far = lambda x: F.coalesce(f"{x}.hi", f"{x}.lo")
        both = a.alias("a").join(b.alias("b"), F.col("a.anchor") == F.col("b.anchor"), "full")
        lo, hi = F.least("a.lo", "b.lo"), F.greatest(far("a"), far("b"))
        return both.select(F.coalesce("a.anchor", "b.anchor").alias("anchor"), lo.alias("lo"), F.when(hi > lo, hi).alias("hi"))

    def add(self, docs: DataFrame) -> None:
        """Indexes a batch and commits it; compacts when there are many runs."""
        key, text = docs.columns[:2]
        rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter(f"doc is not null and length(text) >= {self.window}")
        state = dict(self.state)
        if not state["buckets"]:
            self.state["buckets"] = state["buckets"] = hash_ranges(docs)
        number = state["number"] + 1
        place, run, met = f"places{number}", f"run{number}", f"met{number}"
        rows.mapInArrow(_segments(self.window, self.gram, self.chars), self.PLACE).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{place}")
        own = self._read(place).groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        self._write(own.select("anchor", "lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).alias("hi")), run)
        own = self._run(run)
        new = own.filter("hi is not null").select("anchor")
        for old in state["runs"]:
            a, b = own.alias("a"), self._run(old).alias("b")
            other = ~F.col("a.lo").eqNullSafe(F.col("b.lo")) | F.col("b.hi").isNotNull()
            new = new.union(a.join(b, F.col("a.anchor") == F.col("b.anchor")).filter(other).select("a.anchor"))
        new.distinct().write.mode("overwrite").parquet(f"{self.root}/{met}")
        runs, gone = [*state["runs"], run], []
        if len(runs) >= self.fanout:
            merged = f"merged{number}"
            self._write(reduce(self._merged, [self._run(r) for r in runs]), merged)
            runs, gone = [merged], runs
        state |= {"number": number, "runs": runs, "places": [*state["places"], place], "met": [*state["met"], met]}
        self.log.append(number, state)
        self.state = state
        for r in gone:  # after the commit, when nothing names them any more
            self.spark.sql(f"drop table if exists {self._name(r)}")
            remove(self.spark, f"{self.root}/{r}")

    def _read(self, *names: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{n}" for n in names])

    def spans(self, docs: DataFrame) -> DataFrame:
        """(doc, span_start, span_end) of all indexed records; ``docs`` must hold their texts."""
        if not self.state["places"]:
            return self._none()
        return self._spans(docs, self._read(*self.state["places"]), self._read(*self.state["met"]).distinct())

    def new_spans(self, docs: DataFrame) -> DataFrame:
        """(doc, span_start, span_end) of the records of the last batch; ``docs`` must hold their texts and those of older records."""
        if not self.state["places"]:
            return self._none()
        found = self._spans(docs, self._read(*self.state["places"]), self._read(self.state["met"][-1]))
        own = self._read(self.state["places"][-1]).select("doc").distinct()
        return found.join(own, "doc", "left_semi")

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "doc long, span_start long, span_end long")

    def _spans(self, docs: DataFrame, places: DataFrame, met: DataFrame) -> DataFrame:
        win = self.window
        hits = materialize(places.join(met, "anchor", "left_semi"), "hits")
        kinds = hits.groupBy("anchor", "seg").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "start")).alias("rep"), F.count("*").alias("k"))
        kinds = materialize(kinds, "kinds")
        mixed = kinds.groupBy("anchor").agg(F.count("*").alias("s"))
        kinds = _join_back(kinds, mixed.select("anchor", (F.col("s") > 1).alias("mixed"), F.col("s").alias("k")), ["anchor"])
        at = materialize(_join_back(hits, kinds, ["anchor", "seg"]), "segments")
        whole = at.filter("lo < hi").select("doc", F.col("start").alias("s"), (F.col("start") + F.col("n") - 1 + win).alias("e"))
        # windows to compare: every place of a segment that only one record has, one place of any other
        ask = at.filter(F.col("mixed") & ((F.col("lo") == F.col("hi")) | ((F.col("rep.doc") == F.col("doc")) & (F.col("rep.start") == F.col("start")))))
        ask = ask.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "lo", "hi")).alias("segs"))  # at most the segments of one text
        key, text = docs.columns[:2]
        own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter("text is not null").join(ask, "doc").dropDuplicates(["doc"])
        rows = materialize(own.select("doc", "text", "segs").mapInArrow(_windows(win), "w1 long, w2 long, lo long, hi long, doc long, at int"), "windows")
        both = rows.groupBy("w1", "w2").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count("*").alias("k")).filter("l < h").select("w1", "w2", "k")
        part = _join_back(rows.filter("lo = hi"), materialize(both, "both"), ["w1", "w2"], "left_semi").select("doc", F.col("at").alias("s"), (F.col("at") + win).alias("e"))
        return merge_intervals(whole.union(part)).toDF("doc", "span_start", "span_end")


def merge_intervals(rows: DataFrame) -> DataFrame:
    """(doc, s, e): the union of each record's intervals, touching ones joined."""
    rows = rows.groupBy("doc", "s").agg(F.max("e").alias("e"))
    order = W.partitionBy("doc").orderBy("s")
    before = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("first", (before.isNull() | (F.col("s") > before)).cast("int"))
    rows = rows.withColumn("island", F.sum("first").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("doc", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("doc", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


def shared_spans(docs: DataFrame, window: int = 200, gram: int = 100, batches: int = 2) -> DataFrame:
    """Spans of all records of ``docs`` (id, text), which go into a new index in ``batches`` batches by a hash of the id."""
    index = FingerprintIndex(docs.sparkSession, None, window, gram, buckets=hash_ranges(docs))
    key = docs.columns[0]
    for i in range(batches):
        index.add(docs.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == i))
    return index.spans(docs)
