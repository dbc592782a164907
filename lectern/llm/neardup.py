"""Near-duplicate records with small edits (problem 1): exact similarity join on sets of word shingles.

Method: adaptive multi-match prefixes. All shingles have one global order, rarest first. Let a be the smaller of two records with
Jaccard similarity >= t: they share at least l shingles among the first n_a - ceil(2t / (1 + t) n_a) + l of a (its *index prefix*) and the
first n_b - ceil(t n_b) + l of b (its *probe prefix*), for every l. Each record takes the l with the least estimated cost (postings to
read, plus candidates to verify: at most postings / l); a pair is verified when it has at least the smaller of its two l in
common. No similar pair is lost by this, whatever l the records chose.

Plan. Shingles travel as packed arrays, not as rows:

1. Texts to shingle hashes, cut into hash ranges whose number follows from the bytes of the input. A range finds the document
   frequency of each shingle; shingles of one record can't match and stay there. Shingles that very many records have would make
   their range unbounded: they are found beforehand by a count that is combined before it is shuffled, at most ``HOT_MOST`` of them by
   their definition, and go straight to their record.
2. Repeated shingles go back to their record, which now knows n, the number of shingles ahead of them in the order, and their
   frequencies, and chooses its prefix. Records with equal sets collapse into a class; only its representative goes on.
3. Prefix shingles meet by hash and size class. A meeting counts only if the rest of both records can still hold the overlap
   that they need (positional bound), so text that many records share, but too little of it, gives no candidate.
4. Meetings are counted for each pair; pairs with enough of them are verified on full 64-bit sets, made from the texts again.
5. Before that, while lists hold very many possible pairs, the records of each list are compared with one of them (a *star*, under the
   same count and bounds); what is linked then needs no comparison inside its component. So a group of a third of all records
   costs its length, not its square. What remains between components is always compared: no link is lost.
6. Verified pairs give connected components.

Records of fewer than five tokens have no shingle and are alone. Equal sets are similar (1.0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.shingles import mix, shingle_sets
from lectern.session import hash_ranges, materialize, range_partitions

#: The most shingles that can count as hot: a hot shingle has at least one in this many of all occurrences.
HOT_MOST = 1_000_000
_BACK = "part int, ids binary, counts binary, sizes binary, keys binary, df binary"
_PREFIX = "id long, n int, l int, skip int, full boolean, digest binary, prefix binary"


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that at least 8 and one in 1000 records of a batch have, with their number; and the number of all under null."""
    for batch in batches:
        sets = shingle_sets(batch.column(0).to_pylist())
        h, n = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
        often = n >= max(8, len(sets) // 1000)
        keys = pa.concat_arrays([pa.array(h[often].view(np.int64)), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([keys, pa.array([*n[often].tolist(), int(n.sum())], pa.int64())], ["key", "df"])


def _hot(texts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and frequencies of the hot shingles. The frequencies are lower bounds, equal for all records: they order shingles
    and estimate costs, and no result depends on them."""
    often = materialize(texts.mapInArrow(_often, "key long, df long").groupBy("key").agg(F.sum("df").alias("df")), "often")
    total = often.filter("key is null").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    hot = often.filter(F.col("key").isNotNull() & (F.col("df") >= max(least, total // HOT_MOST))).toArrow()
    keys, df = hot.column("key").to_numpy().view(np.uint64), hot.column("df").to_numpy()
    order = np.argsort(keys)
    return keys[order], np.minimum(df[order], 2**32 - 1).astype(np.uint32)


def _runs(x: np.ndarray) -> list[int]:
    """Bounds of the runs of equal values."""
    return [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else [0]


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "ids", "counts", "sizes", "keys", "df"])


def _pack(parts: int, hot):
    """Shingles of a batch by hash range; hot ones with their frequency by bucket of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_df = hot.value
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            sets = shingle_sets(batch.column(1).to_pylist())
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            if not size.sum():
                continue
            h = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), size)
            part = (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            df = np.zeros(len(h), np.uint32)
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, h), len(hot_keys) - 1)
                is_hot = hot_keys[at] == h
                df[is_hot] = hot_df[at[is_hot]]
                bucket = (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                part[is_hot] = bucket[doc[is_hot]] + parts
            order = np.argsort(part, kind="stable")
            part, doc, h, df = part[order], doc[order], h[order], df[order]
            cuts = _runs(part)
            rows = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                d, count = np.unique(doc[lo:hi], return_counts=True)
                p = int(part[lo])
                keys, freq = ((h[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), b"") if p < parts else (h[lo:hi].tobytes(), df[lo:hi].tobytes())
                rows.append((p % parts, ids[d].tobytes(), count.astype(np.uint32).tobytes(), size[d].astype(np.uint32).tobytes(), keys, freq))
            yield from _table(rows).to_batches()

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _repeated(parts: int):
    """Of one hash range: its shingles that more than one record has, by bucket of records, with their frequencies."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        known = pc.greater(pc.binary_length(table.column("df")), 0)
        hot, table = table.filter(known), table.filter(pc.invert(known))
        rows = list(zip(*(hot.column(c).to_pylist() for c in ("part", "ids", "counts", "sizes", "keys", "df")), strict=True))  # on their way
        ids, counts, sizes = _joined(table, "ids", np.int64), _joined(table, "counts", np.uint32), _joined(table, "sizes", np.uint32)
        low = _joined(table, "keys", np.uint32)
        run_of = np.repeat(np.arange(len(ids), dtype=np.uint32), counts)
        order = np.argsort(low, kind="stable")
        s = low[order]
        cuts = np.array(_runs(s))
        df = np.empty(len(s), np.uint32)
        df[order] = np.repeat(np.diff(cuts), np.diff(cuts))
        kept = np.flatnonzero(df > 1)
        if len(kept):
            bucket = (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            kept = kept[np.argsort(bucket[run_of[kept]], kind="stable")]
            b, r = bucket[run_of[kept]], run_of[kept]
            key = (np.uint64(part) << np.uint64(32)) | low[kept].astype(np.uint64)
            cuts = _runs(b)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                first = np.array(_runs(r[lo:hi]))
                runs = r[lo:hi][first[:-1]]
                rows.append((int(b[lo]), ids[runs].tobytes(), np.diff(first).astype(np.uint32).tobytes(), sizes[runs].tobytes(), key[lo:hi].tobytes(), df[kept[lo:hi]].tobytes()))
        return _table(rows)

    return run


def choose(n: int, df: np.ndarray, threshold: float, most: int, verify_cost: float) -> tuple[int, int]:
    """(l, number of repeated shingles in the prefix) for a record of n shingles whose repeated ones have the frequencies df,
    rarest first; (0, 0) if no other record can be similar."""
    need = int(np.ceil(threshold * n - 1e-9))
    first = n - need + 1 - (n - len(df))
    if first < 1:
        return 0, 0
    most = max(1, min(most, need, len(df) - first + 1))
    postings = np.cumsum(df.astype(np.float64) - 1)[first - 1 : first - 1 + most]
    cost = postings * (1 + verify_cost / np.arange(1, len(postings) + 1))
    best = int(np.argmin(cost))
    return best + 1, first + best


def _prefixes(threshold: float, most: int, verify_cost: float):
    def run(table: pa.Table) -> pa.Table:
        ids, counts, sizes = _joined(table, "ids", np.int64), _joined(table, "counts", np.uint32), _joined(table, "sizes", np.uint32)
        keys, df = _joined(table, "keys", np.uint64), _joined(table, "df", np.uint32)
        doc = np.repeat(ids, counts)
        order = np.lexsort((keys, df, doc))
        doc, keys, df, n_of = doc[order], keys[order], df[order], np.repeat(sizes, counts)[order]
        cuts = _runs(doc)
        rows = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            n = int(n_of[lo])
            l, q = choose(n, df[lo:hi], threshold, most, verify_cost)
            if l:
                full = hi - lo == n
                digest = b""
                if full:
                    k = keys[lo:hi]
                    digest = np.array([mix(k).sum(), mix(k ^ np.uint64(0x5851F42D4C957F2D)).sum(), n], np.uint64).tobytes()
                rows.append((int(doc[lo]), n, l, n - (hi - lo), full, digest, keys[lo : lo + q].tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n", "l", "skip", "full", "digest", "prefix"])

    return run


def _postings(threshold: float):
    """One row for each prefix shingle: its position in its record, and whether it lies in the index prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
            size = np.fromiter(map(len, keys), np.int64, len(keys))
            if not size.sum():
                continue
            i, n, l, skip = (np.repeat(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64), size) for c in ("id", "n", "l", "skip"))
            pos = skip + np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size)
            index = pos < n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + l
            cols = [pa.array(np.concatenate(keys)), pa.array(i), *(pa.array(x.astype(np.int32)) for x in (n, l, pos)), pa.array(index)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "id", "n", "l", "pos", "idx"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "s"])


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sim = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            sim.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim, pa.float64())], ["a", "b", "sim"])


class NearDuplicates:
    """The join over ``records`` (id long, text string; ids unique). Null texts are no records.

    ``groups()`` gives (id, group_id, n_links) for every record: its group, named by the smallest id, and the number of verified links
    that its class representative has (inside a component that is already linked no further pairs are verified). A record without
    any link is its own group. ``range_mb`` is the size of a hash range; ``hot_least`` the fewest occurrences of a hot shingle; ``patience``
    the possible pairs for each posting that are enumerated without a star first. None of them changes the groups.
    """

    def __init__(self, records: DataFrame, threshold: float = 0.8, most_matches: int = 8, verify_cost: float = 4.0, range_mb: int = 8, hot_least: int = 10_000, patience: float = 16.0):
        own = records.select(F.col(records.columns[0]).cast("long").alias("id"), F.col(records.columns[1]).alias("text")).filter("id is not null and text is not null")
        self.threshold, self.patience = threshold, patience
        parts = hash_ranges(records, range_mb)
        width = range_partitions(records.sparkSession, parts)
        self.records = materialize(own, "records")
        hot = records.sparkSession.sparkContext.broadcast(_hot(self.records.select("text"), hot_least))  # at most HOT_MOST entries of 12 bytes
        packed = self.records.mapInArrow(_pack(parts, hot), _BACK).repartition(width, "part")
        repeated = packed.groupBy("part").applyInArrow(_repeated(parts), _BACK).repartition(width, "part")
        self.prefixes = materialize(repeated.groupBy("part").applyInArrow(_prefixes(threshold, most_matches, verify_cost), _PREFIX), "prefixes")
        copies = self.prefixes.filter("full")
        rep = copies.groupBy("digest").agg(F.min("id").alias("rep"))
        self.members = copies.select("id", "digest").join(rep, "digest").select("id", "rep").union(self.prefixes.filter("not full").select("id", F.col("id").alias("rep")))
        self.reps = self.prefixes.filter("not full").drop("digest", "full").union(
            self.prefixes.filter("full").join(rep, F.col("id") == F.col("rep"), "left_semi").drop("digest", "full")
        )

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b) to (a, b, sim), from the texts of the records that occur."""
        pairs = materialize(pairs, "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = materialize(self.records.join(wanted, "id", "left_semi").mapInArrow(_sets, "id long, s binary"), "sets")
        full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        return materialize(full.mapInArrow(_jaccard, "a long, b long, sim double"), "verified")

    def _enough(self, met: DataFrame) -> DataFrame:
        """Pairs (a, b) with a < b of meetings (x, y and their n, l, pos and idx) that meet often enough. A meeting counts if the smaller
        record has it in its index prefix, the sizes fit, and what both have from there on can hold the overlap but for l - 1."""
        t = self.threshold
        small = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
        need = F.ceil(t / (1 + t) * (F.col("nx") + F.col("ny")) - 1e-9)
        rest = F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy"))
        fits = (F.least("nx", "ny") >= t * F.greatest("nx", "ny") - 1e-9) & (rest >= need - F.least("lx", "ly") + 1)
        met = met.filter(F.when(small, F.col("idxx")).otherwise(F.col("idxy")) & fits & (F.col("x") != F.col("y")))
        met = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("met"), F.min(F.least("lx", "ly")).alias("need"))
        return met.filter("met >= need").select("a", "b")

    def links(self) -> DataFrame:
        """Verified pairs (a, b, sim) of representatives, a < b: enough for the components, all between different ones."""
        t = self.threshold
        post = self.reps.mapInArrow(_postings(t), "key long, id long, n int, l int, pos int, idx boolean")
        lists = post.groupBy("key").agg(F.count("*").alias("m"), F.max("idx").alias("any")).filter(F.col("any") & (F.col("m") > 1)).select("key")
        post = materialize(post.join(lists, "key"), "postings")
        side = lambda df, s: df.select("key", F.col("id").alias(s), *[F.col(c).alias(c + s) for c in ("n", "l", "pos", "idx")])
        seen = owner = None
        before = float("inf")
        while True:
            at = post.withColumn("c", F.col("id")) if owner is None else post.join(owner, "id", "left").withColumn("c", F.coalesce("c", "id"))
            by = at.groupBy("key", "c").agg(F.count("*").alias("k"))
            lists = by.groupBy("key").agg(F.sum("k").alias("m"), F.max(F.struct("k", "c")).alias("top")).filter("m > top.k")
            lists = materialize(lists.select("key", "m", F.col("top.c").alias("main"), (F.col("m") - F.col("top.k")).alias("outs")), "lists")
            size = lists.agg(F.sum(F.col("m").cast("double") * F.col("outs")).alias("pairs"), F.sum("m").alias("rows")).first()
            if not size["rows"] or size["pairs"] <= self.patience * size["rows"] or size["pairs"] > 0.7 * before:
                break
            before = size["pairs"]
            outside = at.join(lists, "key").filter("c <> main")
            lead = outside.filter("idx").groupBy("key").agg(F.min(F.struct("id", "n", "l", "pos", "idx")).alias("v")).select("key", "v.*")
            pairs = self._enough(side(outside, "x").join(side(lead, "y"), "key"))
            got = self._verify(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))
            seen = got if seen is None else materialize(seen.union(got), "seen")
            owner = components(seen.filter(F.col("sim") >= t - 1e-12).select("a", "b")).toDF("id", "c")
        # what different components of a list have to be compared for: every pair with a record outside of its largest one
        at = at.join(lists, "key").withColumn("out", F.col("c") != F.col("main"))
        steps = 2 / -np.log(t) if t < 1 else 1e9
        size_class = lambda n: F.floor(F.log(n) * steps)
        most = F.least(F.col("n").cast("double"), (1 + t) / t * (F.col("n") - F.col("pos") + F.col("l") - 1) - F.col("n") + 1e-6)
        probe = at.filter(most >= t * F.col("n") - 1e-6).withColumn("g", F.explode(F.sequence(size_class(F.greatest(F.lit(1.0), F.col("n") * t - 1e-6)), size_class(F.greatest(F.lit(1.0), most)))))
        index = at.filter("idx").withColumn("g", size_class(F.col("n")))
        s = lambda df, x: df.select("key", "g", F.col("id").alias(x), F.col("c").alias("c" + x), *[F.col(c).alias(c + x) for c in ("n", "l", "pos", "idx")])
        met = s(index.filter("out"), "x").join(s(probe, "y"), ["key", "g"]).union(s(index.filter("not out"), "x").join(s(probe.filter("out"), "y"), ["key", "g"]))
        smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
        pairs = self._enough(met.filter((F.col("cx") != F.col("cy")) & smaller))
        good = F.col("sim") >= t - 1e-12
        if seen is None:
            return self._verify(pairs).filter(good)
        return seen.union(self._verify(pairs.join(seen, ["a", "b"], "left_anti"))).filter(good)

    def groups(self) -> DataFrame:
        links = materialize(self.links(), "links")
        group = components(links.select("a", "b")).toDF("rep", "g")
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        own = self.members.join(group, "rep", "left").join(degree, "rep", "left")
        own = own.select("id", F.coalesce("g", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return self.records.select("id").join(own, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def pairs_within(groups: DataFrame) -> DataFrame:
    """(a, b), a < b, for all records of a group: the expansion that p1_found is defined to be."""
    size = groups.groupBy("group_id").agg(F.count("*").alias("size")).filter("size > 1")
    g = groups.join(size, "group_id").select("group_id", "id")
    return g.toDF("g", "a").join(g.toDF("g", "b"), "g").filter("a < b").select("a", "b")
