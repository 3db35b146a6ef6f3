"""A document store as DataFrames: replace, delete, clashes, fingerprints, exact copies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import id_block


def upsert(stored: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """stored with the documents of `new` in place of those with the same key."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_cascade(turns: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """turns without every conversation that has a turn in `gone`."""
    return turns.join(gone.select(key).distinct(), key, "left_anti")


def clashes(new: DataFrame, stored: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys of `new` that another owner's stored rows use."""
    s = stored.select(F.col(key), F.col(owner).alias("__other"))
    return new.join(s, key).where(F.col(owner) != F.col("__other")).select(key).distinct()


def fingerprints(docs: DataFrame, by: str) -> DataFrame:
    """A sha256 for each group of documents (doc_id is a key): equal only if all texts are, in the order of ids.

    A tree of hashes: texts, then blocks of BLOCK ids, then groups. No task holds more than a block's 64 characters a
    document, or 64 characters a block of its group.
    """

    def over(c: str) -> Column:
        marks = F.array_sort(F.collect_list(F.struct(c, "h")))
        return F.sha2(F.array_join(F.transform(marks, lambda m: m["h"]), ""), 256)

    rows = docs.select(by, "doc_id", id_block("doc_id").alias("__block"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    blocks = rows.groupBy(by, "__block").agg(F.count(F.lit(1)).alias("n"), over("doc_id").alias("h"))
    return blocks.groupBy(by).agg(F.sum("n").alias("n"), over("__block").alias("fingerprint"))


def chunk_fingerprints(chunks: DataFrame) -> DataFrame:
    """sha256 over a document's chunk texts, each followed by NUL, in order: (doc_id, n, fingerprint). An index is stale if it differs."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda c: F.concat(c["text"], F.lit("\0")))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(texts, ""), 256).alias("fingerprint"))


def reply_keys(calls: DataFrame, model: str, system: str, max_tokens: int, text: str = "text") -> DataFrame:
    """calls with cache_key: calls that a reply cache may answer alike have the same one. A null text is empty."""
    parts = (F.lit(model), F.lit(system), F.coalesce(F.col(text), F.lit("")), F.lit(str(max_tokens)))
    return calls.withColumn("cache_key", F.sha2(F.concat_ws("\x1f", *parts), 256))


def json_reply_keys(calls: DataFrame, parts: list[Column]) -> DataFrame:
    """calls with cache_key: the sha256 of the parts (strings, none null) as a JSON array, so no part can run into the next."""
    return calls.withColumn("cache_key", F.sha2(F.to_json(F.array(*parts)), 256))


def cached_replies(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """calls with the reply that cache(cache_key, reply) has, or null."""
    return calls.join(cache.select("cache_key", "reply"), "cache_key", "left")


def first_copies(docs: DataFrame) -> DataFrame:
    """The first document of each text, case and spaces aside, with its number of copies."""
    key = F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))), 256)
    return docs.groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def described(docs: DataFrame, by: str, info: str) -> DataFrame:
    """Documents of each group, and the one value of `info` they share; 'mixed' if they differ, null if none has one."""
    one = F.when(F.min(info) == F.max(info), F.min(info)).when(F.min(info).isNotNull(), "mixed")
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), one.alias(info))


def next_in_circle(rows: DataFrame, key: str) -> DataFrame:
    """(key, next): each distinct key with the one after it, the largest with the smallest. Null keys are left out.

    Neighbours are found inside blocks of ids, then a block's largest key meets the next block's smallest.
    """
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key), id_block(key).alias("__block")).distinct()
    inside = keys.withColumn("__in", F.lead(key).over(Window.partitionBy("__block").orderBy(key)))
    firsts = keys.groupBy("__block").agg(F.min(key).alias("__first"))
    order = Window.orderBy("__block")  # one row for each block of ids
    turn = firsts.select("__block", F.coalesce(F.lead("__first").over(order), F.first("__first").over(order)).alias("__following"))
    return inside.join(turn, "__block").select(key, F.coalesce("__in", "__following").alias("next"))


def bulk_batches(docs: DataFrame, rows: int = 500, size: int = 10 << 20) -> DataFrame:
    """(doc_id, bytes, block, batch): batches to send at once, in order of id, of at most `rows` documents and `size` bytes of JSON.

    Batches fill one after the other inside blocks of ids, so blocks are filled by different tasks, from (id, bytes) alone.
    A document over the size is a batch of its own; a null id has a null block.
    """

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "bytes"], kind="stable")
        batch, n, total, at = [], 0, 0, 0
        for b in block["bytes"].tolist():
            if n and (n == rows or total + b > size):
                at, n, total = at + 1, 0, 0
            n, total = n + 1, total + b
            batch.append(at)
        return block.assign(batch=pd.Series(batch, index=block.index, dtype="int64"))

    json = F.to_json(F.struct(*docs.columns))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(json).cast("long").alias("bytes"), id_block("doc_id").alias("block"))
    return sizes.groupBy("block").applyInPandas(fill, "doc_id long, bytes long, block long, batch long")
