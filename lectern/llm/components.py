"""Connected components of an edge table, without ever collecting links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: at most one edge for each node comes out."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up.setdefault(p, p)
                x = up[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in up]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["v", "u"])


def _stamp(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges``; a component is named by its smallest node.

    Columns one and two of ``edges`` are 64-bit node ids. Each round links every node to its smallest known neighbour, first
    over its larger, then over its smaller neighbours (large star, small star); the number of rounds grows with the logarithm
    of the longest chain. Nulls and self-links are dropped, repeated links count once, an empty table gives an empty result.
    A node with very many links is aggregated with map-side combine.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("u")).filter("v is not null and u is not null and v <> u")
    e = materialize(e.mapInArrow(_forest, "v long, u long").distinct(), "edges")
    before = _stamp(e)
    for _ in range(rounds):
        both = e.union(e.select("u", "v"))
        low = both.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        down = both.join(low, F.col("v") == F.col("w")).filter("u > v").select(F.col("u").alias("x"), F.least("v", "m").alias("y"))
        low = down.groupBy(F.col("x").alias("w")).agg(F.min("y").alias("m"))
        star = F.explode(F.array(F.struct(F.col("y").alias("v"), F.col("m").alias("u")), F.struct(F.col("x").alias("v"), F.col("m").alias("u"))))
        small = down.join(low, F.col("x") == F.col("w")).select(star.alias("p")).select("p.v", "p.u")
        e = materialize(small.filter("v <> u").distinct(), "edges")
        after = _stamp(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select("u", "u").distinct())
