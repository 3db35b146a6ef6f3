"""Exact deduplication: binary-fuse filters of immutable snapshots screen the digests of each new batch.

A snapshot never changes, so its filter is built once: keys are dealt to buckets by digest, each bucket of about
KEYS_PER_BUCKET digests gets a 3-wise binary-fuse filter of 8-bit fingerprints (about 1.2 bytes a key). A batch
meets the filters bucket by bucket; digests that no filter knows are new, positives (copies, and one in 256 others)
join the exact bucket of the snapshot. Copies inside a batch are grouped apart from that. Whatever has a copy is at
last grouped by digest AND text, which compares the bytes; counts are combined before every shuffle, so a group of
any size costs each task one row.

Defined results: null text counts as empty; a null doc_id is the largest id (it stays only if its whole group has
none); rows that share both id and text are one document and share its fate; an empty table gives no rows; columns
other than the id and text are ignored by `exact_groups` and kept untouched by `drop_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bucket_count, join_small, written
from .text import mix

KEYS_PER_BUCKET = 100_000
BATCHES = 4
_GOLD = 0x9E3779B97F4A7C15


def normalised(text):
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots of each key in consecutive segments, and its 8-bit fingerprint."""
    h = mix(keys + np.uint64(seed * _GOLD & 0xFFFFFFFFFFFFFFFF))
    base = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    g = mix(h ^ np.uint64(_GOLD))
    at = np.stack([(base + np.uint64(i)) * np.uint64(segment) + ((g >> np.uint64(18 * i)) & mask) for i in range(3)])
    return at.astype(np.int64), (h & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """Binary-fuse filter of distinct uint64 keys; peeled in waves, each wave at once."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 10)))
    segments = max(1, -(-int(n * factor) // segment))
    for seed in range(1, 200):
        at, marks = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        degree = np.bincount(at.ravel(), minlength=size)
        xors = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(xors, row, np.arange(n))
        alone, waves, left = np.flatnonzero(degree == 1), [], n
        while len(alone):
            who, first = np.unique(xors[alone], return_index=True)
            slot = alone[first]
            waves.append((who, slot))
            left -= len(who)
            touched = at[:, who]
            for row in touched:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(xors, row, who)
            alone = np.unique(touched.ravel())
            alone = alone[degree[alone] == 1]
        if not left:
            table = np.zeros(size, np.uint8)
            for who, slot in reversed(waves):
                table[slot] = 0
                others = at[:, who]
                table[slot] = marks[who] ^ table[others[0]] ^ table[others[1]] ^ table[others[2]]
            return np.array([seed, segment, segments], np.int64).tobytes() + table.tobytes()
        if seed % 8 == 0:
            segments += max(1, segments // 10)
    raise RuntimeError("no seed peels the keys")


def in_filter(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key it was built from, and for about one in 256 others."""
    seed, segment, segments = map(int, np.frombuffer(filter_[:24], np.int64))
    table = np.frombuffer(filter_[24:], np.uint8)
    at, marks = _slots(keys.astype(np.uint64), seed, segment, segments)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == marks


def snapshot_filters(groups: DataFrame) -> DataFrame:
    """groups(batch, bucket, digest): a filter for each snapshot and bucket."""

    def build(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(x[:8] for x in table.column("digest").to_pylist()), np.uint64)
        return pa.table({"snapshot": table.column("batch")[:1], "bucket": table.column("bucket")[:1], "filter": pa.array([build_filter(keys)], pa.binary())})

    return groups.groupBy("batch", "bucket").applyInArrow(build, "snapshot int, bucket long, filter binary")


def screen(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests of each batch that a filter of an earlier snapshot knows: (digest, snapshot)."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        digests, batch = left.column("digest").to_pylist(), left.column("batch").to_numpy()
        keys = np.frombuffer(b"".join(x[:8] for x in digests), np.uint64)
        hits: list[int] = []
        of: list[int] = []
        for row in right.to_pylist():
            for i in np.flatnonzero((batch > row["snapshot"]) & in_filter(row["filter"], keys)) if len(keys) else ():
                hits.append(int(i))
                of.append(row["snapshot"])
        return pa.table({"digest": pa.array([digests[i] for i in hits], pa.binary()), "snapshot": pa.array(of, pa.int32())})

    return groups.where("batch > 0").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, "digest binary, snapshot int")


def write_snapshot(docs: DataFrame, path: str, snapshot: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Stores an immutable snapshot under path: its distinct texts with their least id, and a filter for each bucket of digests.

    All snapshots of one path have the same number of buckets. Nothing stored earlier is read or changed."""
    body = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("digest"))
    texts = rows.groupBy("digest", "body").agg(F.min("id").alias("id")).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    texts.write.parquet(f"{path}/texts/snapshot={snapshot}")
    stored = docs.sparkSession.read.schema(texts.schema).parquet(f"{path}/texts/snapshot={snapshot}")
    filters = snapshot_filters(stored.select(F.lit(snapshot).alias("batch"), "bucket", "digest").distinct())
    filters.select("bucket", "filter", F.lit(buckets).alias("buckets")).write.parquet(f"{path}/filters/snapshot={snapshot}")


def screen_batch(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, known_id, keep_id) of an incoming batch against the snapshots stored under path.

    known_id: the least id of a stored text equal to the row's, byte by byte; keep_id: that, or else the least id of the batch's own
    equal texts. The stored filters say which digests may be known; only the texts of those are read and compared.
    """
    spark, most = docs.sparkSession, 2**31 - 1
    filters = spark.read.schema("bucket long, filter binary, buckets int, snapshot int").parquet(f"{path}/filters")
    buckets = filters.select("buckets").first()
    body = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("digest"))
    if buckets is None:
        stored = rows.limit(0).select("digest", "body", F.col("id").alias("known_id"))
    else:
        incoming = rows.select(F.lit(most).alias("batch"), F.pmod(F.xxhash64("digest"), F.lit(buckets[0])).alias("bucket"), "digest").distinct()
        positives = written(screen(incoming, filters.select("snapshot", "bucket", "filter")), "positives")
        texts = spark.read.schema("digest binary, body string, id long, bucket long, snapshot int").parquet(f"{path}/texts")
        stored = join_small(texts, positives.distinct(), ["digest", "snapshot"], "left_semi").groupBy("digest", "body").agg(F.min("id").alias("known_id"))
    own = rows.groupBy("digest", "body").agg(F.min("id").alias("__own")).join(stored, ["digest", "body"], "left")
    out = rows.join(own, ["digest", "body"])
    return out.select(F.col("id").alias(id_col), "digest", "known_id", F.coalesce("known_id", "__own").alias("keep_id"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, digest, keep_id, group_size) for every row. Ids are cut into `batches` equal ranges that arrive in turn,
    each screened against the snapshots before it."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("body"))
    lo, hi, n = docs.agg(F.min(id_col), F.max(id_col), F.count(F.lit(1))).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // batches))
    buckets = bucket_count(n, KEYS_PER_BUCKET * batches)
    digests = written(
        rows.select(
            "id",
            F.unhex(F.sha2("body", 256)).alias("digest"),
            F.least(F.coalesce(F.floor((F.col("id").cast("double") - F.lit(float(lo or 0))) / F.lit(float(width))), F.lit(batches - 1)), F.lit(batches - 1)).cast("int").alias("batch"),
        ),
        "digests",
    )
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")
    groups = written(digests.groupBy("batch", "digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket), "groups")
    filters = snapshot_filters(groups.where(F.col("batch") < batches - 1).select("batch", "bucket", "digest"))
    positives = screen(groups.select("batch", "bucket", "digest"), filters)
    known = groups.select(F.col("batch").alias("snapshot"), "digest")
    copied = written(positives.join(known, ["digest", "snapshot"], "left_semi").select("digest").union(groups.where("n > 1").select("digest")).distinct(), "copied")

    members = join_small(rows.withColumn("digest", F.unhex(F.sha2("body", 256))), copied, "digest", "left_semi")
    classes = members.groupBy("digest", "body").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    per_digest = written(classes.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")), "classes")
    if per_digest.where("texts > 1").limit(1).count():  # different texts under one digest: they part by their bytes
        digests, per_digest, on = rows.withColumn("digest", F.unhex(F.sha2("body", 256))), classes, ["digest", "body"]
    else:
        on = ["digest"]
    return digests.join(per_digest.select(*on, "keep", "n"), on, "left").select(
        F.col("id").alias(id_col),
        "digest",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an earlier id has. A row goes by its id and its text, never by its id alone."""
    copies = exact_groups(docs, id_col, text_col).where(f"NOT ({id_col} <=> keep_id)")
    gone = written(copies.select(F.col(id_col).alias("__gone_id"), F.col("digest").alias("__gone_digest")).distinct(), "gone")
    rows = docs.withColumn("__digest", F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__gone_id")) & (F.col("__digest") == F.col("__gone_digest"))
    return join_small(rows, gone, same, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
