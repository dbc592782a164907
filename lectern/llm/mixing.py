"""Mixing sources to target weights (problem 7).

Method: Sainte-Lague apportionment. The mix is cut into blocks of equal token count, which go to the sources one by one, each to
the highest quotient share / (2 seats + 1), ties to the smaller name; a source whose tokens, each document used at most
``max_repeats`` times, are all given away drops out, and the others fill its place. The seats are given once over the whole mix; shard k
holds the seats that are given k-th, so its quotas are integers, and no rounding repeats from shard to shard. The number of blocks
grows with the mix (``block_tokens``) and with the smallest share (``least_seats`` for it at least).

Then each source's documents stand in a seeded order and are cut into blocks of that token count. A source that needs all its
tokens k times and r blocks more uses every document k times, and once more those of which the larger part lies in the first
r blocks of the seeded order; so a source misses its quota by half a document at most.

The total defaults to the greatest at which every source can reach its share. With a larger ``total_tokens`` small sources fall
short and the report says by how much. Documents with no tokens (null, empty) and those of sources without a target add nothing.
Null sources have no target. A target of zero or null gets nothing.

The running token sums use hash buckets, one for each ``bucket_docs`` documents of a source: totals of buckets first, then sums inside
each bucket; so a source with most of the documents is never sorted in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.bpe import VOCABULARY, token_counts
from lectern.session import materialize


def apportion(shares: dict[str, float], seats: int, left: dict[str, int]) -> dict[str, int]:
    """Seats of each source by highest quotients; ``left`` bounds them. The time doesn't grow with the number of seats: all seats above a
    threshold of the quotient are given at once, then the few at it one by one."""
    live = {n: s for n, s in shares.items() if s and s > 0 and left.get(n, 0) > 0}
    won = dict.fromkeys(shares, 0)
    if not live or seats <= 0:
        return won
    if sum(left[n] for n in live) <= seats:
        return won | {n: left[n] for n in live}

    def above(theta: float) -> dict[str, int]:
        return {n: min(left[n], int((s / theta + 1) / 2)) for n, s in live.items()}

    low, high = min(live.values()) / (2 * seats + 3), 2 * max(live.values())  # all seats lie between
    while sum(above(low).values()) < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if sum(above(middle).values()) >= seats:
            low = middle
        else:
            high = middle
    # a few less than the threshold gives, so that equal quotients are decided by name below
    won |= {n: max(0, w - 1) for n, w in above(high).items()}
    heap = [(-s / (2 * won[n] + 1), n) for n, s in live.items() if won[n] < left[n]]
    heapq.heapify(heap)
    for _ in range(seats - sum(won.values())):
        _, name = heapq.heappop(heap)
        won[name] += 1
        if won[name] < left[name]:
            heapq.heappush(heap, (-live[name] / (2 * won[name] + 1), name))
    return won


class Mix:
    """The mix of ``docs`` (doc_id, text, source) by ``targets`` (source, target_share, max_repeats), a small settings table."""

    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 17, shards: int = 8, blocks: int = 500, total_tokens: int | None = None, vocabulary: str = VOCABULARY, most_sources: int = 100_000,
                 block_tokens: int = 1_000_000, least_seats: int = 20, bucket_docs: int = 50_000):
        spark = docs.sparkSession
        want = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        named = docs.join(want.select("source"), "source", "left_semi").filter("text is not null and text <> '' and doc_id is not null")
        self.counts = materialize(token_counts(named, ["doc_id", "source"], "text", vocabulary).filter("n_tokens > 0"), "tokens")
        sums = self.counts.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("docs"))
        # settings, one row for each source with a target
        rows = want.join(sums, "source", "left").limit(most_sources + 1).collect()
        if len(rows) > most_sources:
            raise ValueError("mix_targets is no settings table")
        self.have = {r["source"]: int(r["have"] or 0) for r in rows}
        self.buckets = {r["source"]: max(1, -(-int(r["docs"] or 0) // bucket_docs)) for r in rows}
        self.repeats = {r["source"]: int(r["max_repeats"] if r["max_repeats"] is not None else 1) for r in rows}
        total_share = sum(r["target_share"] for r in rows) or 1.0
        self.shares = {r["source"]: r["target_share"] / total_share for r in rows}
        cap = {s: self.have[s] * self.repeats[s] for s in self.have}
        usable = [cap[s] / self.shares[s] for s in cap if cap[s]]
        self.total = int(total_tokens if total_tokens is not None else min(usable, default=0))
        smallest = min((x for s, x in self.shares.items() if cap[s]), default=1.0)
        self.blocks = max(blocks, -(-self.total // (shards * block_tokens)), -int(-least_seats // (smallest * shards)))
        self.block = max(1, self.total // (shards * self.blocks))
        left = {s: round(cap[s] / self.block) for s in cap}
        # quotas of the first k shards together; seats are given one after the other, so each is a part of the next
        self.ends = [apportion(self.shares, self.blocks * (k + 1), left) for k in range(shards if self.total else 0)]
        self.quotas = self.ends[-1] if self.ends else dict.fromkeys(self.shares, 0)
        self.seed, self.spark = seed, spark

    def rows(self) -> DataFrame:
        """(doc_id, source, use_no, shard, n_tokens): one row for each use of a document, use_no from 1."""
        plan = []
        for s, have in self.have.items():
            need = self.quotas.get(s, 0)
            full = min(self.repeats[s], need * self.block // have) if have else 0
            rest = need * self.block - full * have if full < self.repeats[s] else 0
            plan.append((s, have, int(full), int(max(0, rest)), self.buckets[s], [e.get(s, 0) * self.block for e in self.ends] or [0]))
        if not plan:
            return self.counts.select("doc_id", "source", F.lit(1).alias("use_no"), F.lit(0).alias("shard"), "n_tokens").limit(0)
        plan = F.broadcast(self.spark.createDataFrame(plan, "source string, have long, full long, rest long, buckets long, ends array<long>"))  # settings
        d = self.counts.join(plan, "source").withColumn("h", F.xxhash64("doc_id", F.lit(self.seed)))
        d = d.withColumn("bucket", F.shiftright(F.shiftrightunsigned("h", 32) * F.col("buckets"), 32))  # in the order of h as an unsigned number
        sums = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
        ahead = F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select("source", "bucket", ahead.alias("ahead"))  # one row for each bucket_docs documents
        inside = F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
        d = d.withColumn("inside", inside).join(sums.hint("merge"), ["source", "bucket"]).withColumn("at", F.col("ahead") + F.col("inside") - F.col("n_tokens"))
        middle = F.col("at") * 2 + F.col("n_tokens")
        uses = F.col("full") + F.when(middle <= 2 * F.col("rest"), 1).otherwise(0)
        d = d.filter(uses > 0).withColumn("use_no", F.explode(F.sequence(F.lit(1).cast("long"), uses)))
        place = F.col("at") + (F.col("use_no") - 1) * F.col("have")
        shard = F.least(F.size(F.filter("ends", lambda e: e <= place)), F.size("ends") - 1)
        return d.select("doc_id", "source", F.col("use_no").cast("int").alias("use_no"), shard.alias("shard"), "n_tokens")

    def report(self) -> DataFrame:
        """For each source with a target: what it has, what it gives to the mix and the share that it reached."""
        used = self.rows().groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.countDistinct("doc_id").alias("docs"), F.max("use_no").alias("most_uses"))
        plan = [(s, self.shares[s], self.repeats[s], self.have[s], self.quotas.get(s, 0)) for s in self.have]
        plan = self.spark.createDataFrame(plan, "source string, target_share double, max_repeats int, tokens long, blocks int")
        zero = F.lit(0)
        out = plan.join(used, "source", "left").withColumns({c: F.coalesce(c, zero) for c in ("mixed_tokens", "docs", "most_uses")})
        all_tokens = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))  # over the settings' rows
        return out.withColumn("reached_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), all_tokens), F.lit(0.0)))
