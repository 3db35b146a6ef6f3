"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

n rows that lie on workers go to shards whose sizes are fixed beforehand (they differ by one row at most). How many rows
worker i sends to each shard is row i of a matrix with given row and column sums, drawn from the exact multivariate
hypergeometric law. No one holds the matrix: a worker finds its own row by walking down a binary tree over the workers,
drawing at each node, from a generator seeded by that node, how the node's shards divide between its halves; that is
shards x log(workers) draws. Then it permutes its rows' labels, rows are exchanged, and each shard is permuted again: a
hash of a row's place deals it to one of the shard's blocks of about BLOCK rows and orders it there; slots count on over
the blocks by a small table of their sizes. So every order of all rows is equally likely, for the seed.

Workers are the tasks that first wrote the rows; their number and each row's place in them are written with the rows,
so a repeated task repeats the same decisions.

Defined results: rows are dealt one by one: null ids, repeated rows and equal texts need no special care; empty tables
give no rows; input columns named shard or slot are replaced.
"""

from __future__ import annotations

from math import exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bucket_count, join_small, written

SHARDS, BLOCK, SEED = 16, 20_000, 11


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw; beyond NumPy's range by ratio of uniforms with the exact weights."""
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    total = good + bad
    if draws > total - draws:
        return good - _hypergeometric(rng, good, bad, total - draws)
    lo, hi = max(0, draws - bad), min(good, draws)
    weigh = lambda x: -(lgamma(x + 1) + lgamma(good - x + 1) + lgamma(draws - x + 1) + lgamma(bad - draws + x + 1))
    mode = int((draws + 1) * (good + 1) / (total + 2))
    spread = sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1) + 0.5)
    width, top = 1.7155277699214135 * spread + 0.8989161620588988, weigh(mode)
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = int(np.floor(mode + 0.5 + width * (v - 0.5) / u))
        if lo <= x <= hi and 2 * log(u) <= weigh(x) - top:
            return x


def _split(rng: np.random.Generator, cells: np.ndarray, draws: int) -> np.ndarray:
    """How many of each cell are among `draws` of all."""
    if cells.sum() < 10**9:
        return rng.multivariate_hypergeometric(cells, draws, method="marginals") if len(cells) > 1 else np.array([draws])
    out, left = np.zeros_like(cells), int(cells.sum())
    for i, c in enumerate(cells):
        left -= int(c)
        out[i] = _hypergeometric(rng, int(c), left, draws)
        draws -= int(out[i])
    return out


def matrix_row(worker: int, counts: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """How many rows this worker sends to each cell; rows of all workers add up to `cells`."""
    lo, hi = 0, len(counts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        part = _split(np.random.Generator(np.random.PCG64([seed, lo, hi])), cells, int(counts[lo:mid].sum()))
        lo, hi, cells = (lo, mid, part) if worker < mid else (mid, hi, cells - part)
    return cells


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes of the shards, one row apart at most."""
    return rows // shards + (np.arange(shards) < rows % shards)


def _shard_of(workers: list[int], counts: list[int], sizes: np.ndarray, seed: int):
    """A column function of (worker, place in the worker): the shard of a row."""
    place, counts = {w: i for i, w in enumerate(workers)}, np.array(counts, np.int64)
    dealt: dict[int, np.ndarray] = {}  # labels of the worker at hand

    @F.arrow_udf("int")
    def shard(worker: pa.Array, nth: pa.Array) -> pa.Array:
        worker, nth = worker.to_numpy(zero_copy_only=False), nth.to_numpy(zero_copy_only=False)
        out = np.zeros(len(worker), np.int32)
        for w in np.unique(worker).tolist():
            if w not in dealt:
                dealt.clear()
                labels = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(place[w], counts, sizes, seed))
                np.random.Generator(np.random.PCG64([seed, place[w], 1 << 20])).shuffle(labels)
                dealt[w] = labels
            mine = worker == w
            out[mine] = dealt[w][nth[mine]]
        return pa.array(out)

    return shard


def shard_rows(df: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """df with shard and slot; slots of a shard are 0 to its size less one."""
    df = df.drop("shard", "slot")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    table = written(df.withColumn("__worker", F.spark_partition_id()).withColumn("__nth", place), "rows")
    counts = sorted(tuple(r) for r in table.groupBy("__worker").count().collect())  # one row for each task that wrote rows
    n = sum(c for _, c in counts)
    blocks = bucket_count(-(-n // shards), block)
    shard = _shard_of([w for w, _ in counts], [c for _, c in counts], shard_sizes(n, shards), seed)
    key = F.xxhash64("__worker", "__nth", F.lit(seed))
    dealt = table.withColumn("shard", shard("__worker", "__nth")).withColumn("__key", key).withColumn("__block", F.pmod("__key", F.lit(blocks)))
    sizes = dealt.groupBy("shard", "__block").count()
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = written(sizes.select("shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")), "starts")
    again = Window.partitionBy("shard", "__block").orderBy("__key", "__worker", "__nth")
    placed = join_small(dealt, starts, ["shard", "__block"], "inner", shards * blocks)
    return placed.select(*df.columns, "shard", (F.col("__start") + F.row_number().over(again) - 1).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Files of each shard in the order of slots, in folders shard=N."""
    shard_rows(df, shards).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return shard_rows(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
