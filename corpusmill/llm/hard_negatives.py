"""Hard-negative mining: for each anchor and each of its positives, the best rows of other labels within a band of scores.

A row is a vector of whole numbers, floor(SCALE x) of its components; scores are inner products. Rows lie in blocks of similar
length (one shuffle by length), and a block holds, for every coordinate, its rows' sorted values of unit length. An anchor meets
a block with the least score that still counts for it: (1) if even the longest row of the block can't reach it, the block is
left out; (2) otherwise that score means an angle, and the angle means a feasible range of values in each of the
anchor's FOCUS largest coordinates: the shortest range in the sorted lists gives the candidates, the other
ranges thin them; (3) candidates are scored exactly. Anchors whose shortest range holds most of the block are scored together by one product.
The least score rises as a task goes through its blocks: at most the best `top` of each list are kept, and nothing else leaves it.

First come the positives (same label), then the negatives: their least score is the lower end of the lowest band, and for each
positive the score of its last kept negative. Anchors are sent to the blocks in batches of at most BATCH_BYTES, so what is broadcast
doesn't grow with the table.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part; shorter vectors
count as if zeros followed; of rows that share an id the one with the least label and vector stays; ties go to the smaller id;
an anchor without positives or a positive without negatives has no rows; an empty table gives none; other columns are ignored. Scores
are exact below 2^55; vectors that could exceed this are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bucket_count, join_small, written

SCALE, TOP = 256, 5
ROWS, ANCHORS, BATCH_BYTES = 4096, 512, 32 << 20
FOCUS = 3
#: Anchors whose shortest range holds more than this share of a block are scored by a product.
MOST = 0.25
_NONE = -(1 << 62)


def whole_rows(embeddings: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, label, v: whole numbers, size: squared length) of the rows that take part, one an id."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x")).where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(fine)
    rows = rows.select("id", "label", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
    again = written(rows.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if again.limit(1).count():
        one = join_small(rows, again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
        rows = join_small(rows, again, "id", "left_anti").unionByName(one)
    size = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.withColumn("size", size)


def _packed(most: int, width: int):
    """(id, label, v) -> blocks of at most `most` rows: ids, labels, a matrix of longs, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            v = rows.column("v").combine_chunks()
            n = np.diff(v.offsets.to_numpy())
            matrix = np.zeros((rows.num_rows, width), np.int64)
            matrix[np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = v.flatten().to_numpy()
            order = np.argsort(rows.column("id").to_numpy(), kind="stable")
            columns = [rows.column("id").to_numpy()[order], rows.column("label").to_numpy()[order], matrix[order]]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "labels", "matrix"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= most:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, most))
                held = [b for b in rows.slice(most).to_batches() if b.num_rows]
        if held:
            yield block(pa.Table.from_batches(held))

    return run


_BLOCK = "ids binary, labels binary, matrix binary"


class Block:
    """Rows in the order of their ids, their lengths, and for each coordinate the rows by their values of unit length."""

    def __init__(self, ids: bytes, labels: bytes, matrix: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.rows = np.frombuffer(matrix, np.int64).reshape(len(self.ids), -1)
        self.length = np.sqrt((self.rows.astype(float) ** 2).sum(1))
        self.longest = float(self.length.max())
        self._lists: tuple | None = None

    @property
    def unit(self) -> np.ndarray:
        return self.rows / np.maximum(self.length, 1e-300)[:, None]

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit rows, rows by value, sorted values), the last two a coordinate."""
        if self._lists is None:
            unit = self.unit
            order = np.argsort(unit, axis=0, kind="stable")
            self._lists = unit, order.T.copy(), np.take_along_axis(unit, order, 0).T.copy()
        return self._lists


def products(anchors: Block, which: np.ndarray, rows: Block) -> np.ndarray:
    """Exact scores: the partial sums of a product stay below |a||b|, so short vectors need fewer bits."""
    most = anchors.longest * rows.longest
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (anchors.rows[which].astype(kind) @ rows.rows.astype(kind).T).astype(np.int64)


def feasible(anchor_unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinates, least, most): each anchor's FOCUS largest coordinates, and the values that a unit vector within the angle may have there."""
    focus = np.argsort(-np.abs(anchor_unit), axis=1, kind="stable")[:, :FOCUS]
    own = np.arccos(np.clip(np.take_along_axis(anchor_unit, focus, 1), -1, 1))
    angle = np.arccos(np.clip(cosine, -1, 1))[:, None]
    return focus, np.cos(np.minimum(np.pi, own + angle)) - 1e-9, np.cos(np.maximum(0.0, own - angle)) + 1e-9


def candidates(anchors: Block, rows: Block, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of every pair whose score is at least the anchor's `least`, and maybe of others below."""
    if not len(rows.ids):
        return
    reach = anchors.length * rows.longest
    met = np.flatnonzero(reach * (1 + 1e-9) >= least)  # by length
    cosine = np.full(len(anchors.ids), -1.0)
    positive = (reach > 0) & (least > 0)
    cosine[positive] = np.minimum(1.0, least[positive] / reach[positive]) - 1e-9
    narrow = met[cosine[met] > 0]
    whole = [met[cosine[met] <= 0]]
    if len(narrow):
        unit, order, values = rows.lists()
        focus, low, high = feasible(anchors.rows[narrow] / np.maximum(anchors.length[narrow], 1e-300)[:, None], cosine[narrow])
        begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            i, j = np.nonzero(focus == f)
            begin[i, j], end[i, j] = np.searchsorted(values[f], low[i, j]), np.searchsorted(values[f], high[i, j], "right")
        best = (end - begin).argmin(1)
        count = (end - begin)[np.arange(len(narrow)), best]
        wide = count > MOST * len(rows.ids)
        whole.append(narrow[wide])
        for k in np.flatnonzero(~wide & (count > 0)):
            found = order[focus[k, best[k]], begin[k, best[k]] : end[k, best[k]]]
            for j in range(focus.shape[1]):
                if j != best[k]:
                    value = unit[found, focus[k, j]]
                    found = found[(value >= low[k, j]) & (value <= high[k, j])]
            if len(found):
                a = narrow[k : k + 1]
                yield np.repeat(a, len(found)), found, (rows.rows[found] @ anchors.rows[a[0]]).astype(np.int64)
    together = np.concatenate(whole)
    for lo in range(0, len(together), 256):
        some = together[lo : lo + 256]
        score = products(anchors, some, rows)
        a, r = np.nonzero(score >= least[some][:, None])
        yield some[a], r, score[a, r]


def first_of(keys: list[np.ndarray], score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the first `top` of each key: higher scores, then smaller ids, come first."""
    order = np.lexsort((ids, -score, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < top]


class Kept:
    """Per anchor and list the best `top` found so far, as rows (anchor, list, score, id)."""

    def __init__(self, lists: int, top: int) -> None:
        self.lists, self.top, self.rows = lists, top, np.zeros((4, 0), np.int64)

    def add(self, anchor: np.ndarray, number: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([anchor, number, score, ids])], 1)
        self.rows = rows[:, first_of([rows[0], rows[1]], rows[2], rows[3], self.top)]

    def least(self, anchors: int) -> np.ndarray:
        """Anchors x lists: the score of the last one kept where a list is full, else far below any."""
        a, number, score, _ = self.rows
        full = np.zeros((anchors, self.lists), np.int64)
        np.add.at(full, (a, number), 1)
        low = np.full((anchors, self.lists), np.iinfo(np.int64).max)
        np.minimum.at(low, (a, number), score)
        return np.where(full >= self.top, low, _NONE)


def _meet_batches(top: int, band: tuple[int, int] | None):
    """Blocks x anchor blocks -> (anchor_id, positive_id, other_id, score): per anchor (and, with a band, positive) the best of the task's blocks.

    Without a band the others have the anchor's label; with one, another label and a score in the band of the positive's score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple[Block, np.ndarray, np.ndarray, Kept]] = {}
        last: tuple[bytes, Block] | None = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("ids", "labels", "matrix", "a_ids", "a_labels", "a_matrix", "p_ids", "p_scores")]
            for i in range(batch.num_rows):
                ids, labels, matrix, a_ids, a_labels, a_matrix, p_ids, p_scores = (c[i].as_buffer().to_pybytes() for c in columns)
                if last is None or last[0] != ids:
                    last = ids, Block(ids, labels, matrix)
                rows = last[1]
                if a_ids not in kept:
                    block = Block(a_ids, a_labels, a_matrix)
                    positives = np.frombuffer(p_ids, np.int64).reshape(len(block.ids), -1)
                    kept[a_ids] = block, positives, np.frombuffer(p_scores, np.int64).reshape(positives.shape), Kept(max(1, positives.shape[1]), top)
                anchors, _, scores, best = kept[a_ids]
                if anchors.longest * rows.longest >= 2.0**55:
                    raise ValueError("vectors too long for exact scores")
                least = best.least(len(anchors.ids))
                if band is None:
                    low = least.min(1)
                else:  # a positive below 0 has no band; a missing one is far below
                    floor = np.where(scores >= 0, -(-band[0] * scores // band[1]), np.iinfo(np.int64).max)
                    low = np.maximum(floor, least).min(1)
                found = [f for f in candidates(anchors, rows, low) if len(f[0])]
                if not found:
                    continue
                a, r, score = (np.concatenate(x) for x in zip(*found, strict=True))
                same = anchors.labels[a] == rows.labels[r]
                if band is None:
                    good = same & (anchors.ids[a] != rows.ids[r]) & (score >= low[a])
                    best.add(a[good], np.zeros(int(good.sum()), np.int64), score[good], rows.ids[r[good]])
                    continue
                for j in range(scores.shape[1]):
                    good = ~same & (score <= scores[a, j]) & (score >= floor[a, j]) & (score >= least[a, j])
                    best.add(a[good], np.full(int(good.sum()), j), score[good], rows.ids[r[good]])
        for anchors, positives, _, best in kept.values():
            a, number, score, other = best.rows
            positive = positives[a, number] if positives.shape[1] else np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.ids[a], positive, other, score)], names=["anchor_id", "positive_id", "other_id", "score"])

    return run


def _anchor_blocks(anchors: DataFrame, width: int) -> DataFrame:
    """anchors(id, label, v, positives) -> blocks of at most ANCHORS, with the positives' ids and scores as matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, ANCHORS):
                part = big.slice(lo, ANCHORS)
                block = next(_packed(ANCHORS, width)(iter([part])))
                given = part.column(part.schema.get_field_index("positives")).to_pylist()
                order = np.argsort(part.column(part.schema.get_field_index("id")).to_numpy(), kind="stable")
                most = max(map(len, given))
                ids, scores = np.zeros((len(given), most), np.int64), np.full((len(given), most), -1, np.int64)
                for row, k in enumerate(order):
                    for j, p in enumerate(given[k]):
                        ids[row, j], scores[row, j] = p["id"], p["score"]
                extra = [pa.array([x.tobytes()], pa.binary()) for x in (ids, scores)]
                yield pa.RecordBatch.from_arrays([*block.columns, *extra], names=["a_ids", "a_labels", "a_matrix", "p_ids", "p_scores"])

    return anchors.select("id", "label", "v", "positives").mapInArrow(run, "a_ids binary, a_labels binary, a_matrix binary, p_ids binary, p_scores binary")


def _best(blocks: DataFrame, anchors: DataFrame, width: int, batches: int, top: int, band: tuple[int, int] | None) -> DataFrame:
    """(anchor_id, positive_id, other_id, score, rank): the first `top` of all blocks."""
    place, found, parts = F.pmod(F.xxhash64("id"), F.lit(batches)), [], bucket_count(anchors.count(), ANCHORS * batches)
    for b in range(batches):  # each batch is at most about BATCH_BYTES
        mine = _anchor_blocks(anchors.where(place == b).repartition(parts), width)
        met = blocks.crossJoin(F.broadcast(mine)).mapInArrow(_meet_batches(top, band), "anchor_id long, positive_id long, other_id long, score long")
        found.append(written(met, "met"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")  # `top` rows a task at most
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def hard_negatives(embeddings: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = TOP, negatives: int = TOP, band: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor and label are expressions over the table's columns. Of an anchor the first `positives` rows of its label count; for each
    of them the first `negatives` rows of other labels whose score is at least band[0] / band[1] of the positive's and at most it.
    """
    rows = written(whole_rows(embeddings, label, id_col, vector_col), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, 1)
    chosen = written(join_small(rows, written(embeddings.where(is_anchor).select(F.col(id_col).cast("long").alias("id")).distinct(), "anchors"), "id", "left_semi").select("id", "label", "v"), "chosen")
    dealt = rows.repartitionByRange(bucket_count(n, ROWS), F.desc("size"), "id").sortWithinPartitions(F.desc("size"), "id").select("id", "label", "v")
    blocks = written(dealt.mapInArrow(_packed(ROWS, width), _BLOCK), "blocks")
    batches = bucket_count(chosen.count() * (width * 8 + 16 + 16 * positives), BATCH_BYTES)
    none = F.array().cast("array<struct<id:long,score:long>>")
    found = written(_best(blocks, chosen.withColumn("positives", none), width, batches, positives, None), "positives")
    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("other_id").alias("id"), "score"))).alias("p"))  # `positives` at most
    lists = lists.select(F.col("anchor_id").alias("id"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives"))
    wanted = written(chosen.join(lists, "id"), "wanted")
    got = _best(blocks, wanted, width, batches, negatives, band)
    known = found.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return got.join(known, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"), F.expr("vec_id % 100 = 0"), label)
