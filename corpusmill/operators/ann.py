"""Approximate vector search: an inverted file of lists around centroids, a measured number of lists to look at, exact scores.

Centroids are fitted by k-means on at most SAMPLE vectors (a hash of the id chooses them); every vector goes to the list of its
nearest centroid. How many lists a question has to look at is measured: for at most TRIALS questions the exact best k are found by
brute force, and the least number with which `recall` of them lie in the lists looked at is taken, doubling from one up
to all lists, with which nothing can be missed. Questions then meet the lists as equi-joins, are scored exactly in blocks, and scores
are clamped to -1..1.

Defined results: a null id or vector takes no part; of rows that share an id any may be found; vectors are of one length; ties go to the
smaller id; scores are rounded to 6 decimals as in `retrieval.dense`; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import retrieval

SAMPLE, TRIALS, MOST_LISTS, ROUNDS, BLOCK = 20_000, 64, 1024, 10, 1024


def _matrix(vectors: DataFrame, key: str, most: int, seed: str) -> np.ndarray:
    """At most `most` vectors, chosen by a hash of the id."""
    narrow = vectors.select(key).where(f"{key} IS NOT NULL").distinct()
    chosen = narrow.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)
    rows = vectors.where("embedding IS NOT NULL").join(F.broadcast(chosen), key).groupBy(key).agg(F.min("embedding").alias("embedding")).orderBy(key)
    got = rows.select("embedding").toPandas()["embedding"]  # `most` rows at most
    return np.stack(got).astype(np.float64) if len(got) else np.zeros((0, 0))


def fit_centroids(vectors: DataFrame, key: str = "vec_id", lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """k-means from evenly spaced sample rows; about the square root of the sample's size of lists unless told."""
    x = _matrix(vectors, key, sample, "centroids")
    k = min(len(x), MOST_LISTS, lists or max(1, int(len(x) ** 0.5)))
    if not k:
        return x
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres, 1)[:, 0]
        for j in np.unique(near):
            centres[j] = x[near == j].mean(0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Rows x n: the numbers of the nearest centroids, the nearest first."""
    far = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def with_lists(vectors: DataFrame, centres: np.ndarray, n: int, key: str = "vec_id") -> DataFrame:
    """(key, embedding, list) for the n nearest centroids of each vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f) and len(centres):
                found = nearest(np.stack(f["embedding"]).astype(np.float64), centres, n)
                out = f.loc[f.index.repeat(found.shape[1])].copy()
                out["list"] = found.ravel()
                yield out

    rows = vectors.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding")).where(f"{key} IS NOT NULL AND embedding IS NOT NULL")
    return rows.mapInPandas(run, f"{key} long, embedding array<double>, list int")


def lists_needed(vectors: DataFrame, questions: DataFrame, centres: np.ndarray, k: int, recall: float, key: str = "vec_id", trials: int = TRIALS) -> tuple[int, float]:
    """(lists, recall measured): how many lists to look at so that `recall` of the exact best k of some questions lie in them."""
    chosen = questions.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(trials)
    some = questions.join(F.broadcast(chosen), key)
    best = stored(retrieval.dense(vectors, some, k, key), "exact")
    homes = with_lists(vectors.join(F.broadcast(best.select(key).distinct()), key, "left_semi"), centres, 1, key).select(key, "list")  # trials * k rows at most
    ranks = with_lists(some, centres, len(centres), key).groupBy(key).agg(F.collect_list("list").alias("order")).select(F.col(key).alias("q_id"), "order")
    seen = best.join(homes, key).join(ranks, "q_id").select(F.array_position("order", F.col("list")).alias("place")).groupBy("place").count().collect()  # a number a list
    total, n = sum(r["count"] for r in seen), 1
    share = lambda n: sum(r["count"] for r in seen if r.place <= n) / total if total else 1.0
    while n < len(centres) and share(n) < recall:
        n *= 2
    n = min(n, max(1, len(centres)))
    return n, share(n)


def search(vectors: DataFrame, questions: DataFrame, centres: np.ndarray, k: int, probes: int, key: str = "vec_id") -> DataFrame:
    """(q_id, key, score, rank): the best k of the lists looked at, with exact, clamped scores. A list's questions and vectors meet in blocks."""
    index = with_lists(vectors, centres, 1, key).select("list", F.col(key).alias("id"), "embedding")
    asked = with_lists(questions, centres, probes, key).select("list", F.col(key).alias("q_id"), F.col("embedding").alias("q"))

    def packed(df: DataFrame, ident: str, vector: str, prefix: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for number, part in f.groupby("list"):
                    for at in range(0, len(part), BLOCK):
                        p = part.iloc[at : at + BLOCK]
                        yield pd.DataFrame({"list": [number], f"{prefix}s": [p[ident].to_numpy(np.int64).tobytes()], f"{prefix}m": [np.stack(p[vector]).astype(np.float64).tobytes()]})

        return df.sortWithinPartitions("list").mapInPandas(run, f"list int, {prefix}s binary, {prefix}m binary")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                q, v = np.frombuffer(r.qs, np.int64), np.frombuffer(r.vs, np.int64)
                score = np.clip(np.round(np.frombuffer(r.qm).reshape(len(q), -1) @ np.frombuffer(r.vm).reshape(len(v), -1).T, 6), -1.0, 1.0)
                order = np.lexsort((np.broadcast_to(v, score.shape), -score), axis=1)[:, :k]
                yield pd.DataFrame({"q_id": np.repeat(q, order.shape[1]), key: v[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()})

    met = packed(index, "id", "embedding", "v").join(packed(asked, "q_id", "q", "q"), "list").mapInPandas(run, f"q_id long, {key} long, score double")
    return retrieval.top(met, k, ["q_id"], key)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: hits of the exact search, how many of them were found, and their share (4 decimals)."""
    mark = found.select("q_id", key, F.lit(True).alias("__found"))
    rows = exact.join(mark, ["q_id", key], "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("__found").alias("found"))
    return rows.withColumn("recall", F.round(F.col("found") / F.greatest("wanted", F.lit(1)), 4))
