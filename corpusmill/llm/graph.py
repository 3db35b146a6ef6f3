"""Connected components: tasks contract EDGES edges each, then large-star and small-star steps alternate over what is left.

A graph of fewer edges is done after the contraction. Every step is a grouped minimum (combined before the shuffle) and an equi-join that adaptive execution can split,
so a node with very many neighbours is no single task's work. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bucket_count, written

#: Edges that one task contracts: about this many fit its memory easily.
EDGES = 1 << 19


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one task -> an edge from each node to the smallest node it is connected to there."""
    top: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            while (up := top.setdefault(a, a)) != a:
                top[a] = a = top[up]
            while (up := top.setdefault(b, b)) != b:
                top[b] = b = top[up]
            if a != b:
                top[max(a, b)] = min(a, b)
    out: tuple[list, list] = ([], [])
    for x in top:
        root = x
        while top[root] != root:
            root = top[root]
        top[x] = root
        if root != x:
            out[0].append(x)
            out[1].append(root)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges(u, v) long -> (node, component): the smallest node of its component, for every node that has an edge to another.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now, before = written(now, "edges"), None
    parts = bucket_count(now.count(), EDGES)
    now = written(now.coalesce(parts).mapInArrow(_contracted, "u long, v long"), "edges")
    if parts == 1:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    for _ in range(max_rounds):
        mark = _mark(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v")
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
