"""The documents that share most distinct words with each of many questions, exactly.

Every question meets every document, so the pairs that share a word grow with both tables at once. None of them becomes a row: documents
and questions are packed in blocks, by word; where two blocks meet, each word they share is a string of bits, one a document, and
a question's scores are added up over its words, 64 documents in one operation. A task keeps the first k of each question, and what
can't enter them is passed over, so k rows a question and part of the documents are all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import stored, stored_blocks
from . import blocks
from .retrieval import BROADCAST_TERMS, top

#: Questions that are added up together.
TOGETHER = 32
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.where(f"{key} IS NOT NULL").select(F.col(key).cast("long").alias("id"), F.explode(F.array_distinct(tx.tokens(text))).alias("term"))


def _block(ids: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """Rows sorted by id -> one row: the ids, the words that any of them has, and for each word the places of those that have it."""
    fresh = blocks.edges(ids)
    keys, at = ids[fresh], np.cumsum(fresh) - 1
    order = np.argsort(words, kind="stable")
    words, at = words[order], at[order]
    new = blocks.edges(words, at)  # an id that came twice counts once
    words, at = words[new], at[new]
    begins = np.flatnonzero(blocks.edges(words))
    return blocks.row(keys, words[begins], np.append(begins, len(words)).astype(np.int32), at.astype(np.uint16), names="ids words begins places")


def packed(rows: DataFrame, keys: int, size: int) -> DataFrame:
    """rows(id, word), numbers both -> blocks of up to `size` ids; keys: about how many ids there are. An id is in one block only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in blocks.cut(batches, size, most):
            yield _block(ids, words)

    most = blocks.ROWS
    return rows.repartition(max(1, -(-keys // size)), "id").sortWithinPartitions("id").mapInArrow(run, "ids binary, words binary, begins binary, places binary")


def _planes(bits: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """How many of bits[rows[i]] have each bit set, as binary digits, lowest first: three of a level become one and a carry."""
    levels: list[list[np.ndarray]] = [[]]

    def put(i: int, x: np.ndarray) -> None:
        while True:
            if i == len(levels):
                levels.append([])
            levels[i].append(x)
            if len(levels[i]) < 3:
                return
            a, b, c = levels[i]
            odd = a ^ b
            levels[i] = [odd ^ c]
            x, i = (a & b) | (odd & c), i + 1

    for j in range(rows.shape[1]):
        put(0, bits[rows[:, j]])
    i = 0
    while i < len(levels):
        if len(levels[i]) == 2:
            a, b = levels[i]
            levels[i] = [a ^ b]
            put(i + 1, a & b)
        i += 1
    return [x[0] for x in levels]


def _beyond(planes: list[np.ndarray], score: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The documents that enter: more than `score`, or as much (over 0) and a place under `before`."""
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], _ALL)
    for i in reversed(range(len(planes))):
        digit = np.where(score >> i & 1, _ALL, np.uint64(0))[:, None]
        more |= same & planes[i] & ~digit
        same &= ~(planes[i] ^ digit)
    if before.any():
        left = np.clip(before[:, None] - 64 * np.arange(same.shape[1]), 0, 64).astype(np.uint64)
        first = np.where(left == 64, _ALL, (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
        more |= np.where((score > 0)[:, None], same & first, np.uint64(0))
    return more


def _set_bits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"))


def _first(planes: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, score) of the k documents of `among` with the highest scores in each row; equal scores by place."""
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)[:, None]
    sure, tied = np.zeros_like(among), among.copy()
    for p in reversed(planes):
        upper = tied & p
        n = count(sure | upper)
        sure, tied = np.where(n <= k, sure | upper, sure), np.where(n > k, upper, np.where(n < k, tied & ~p, np.uint64(0)))
    row, place = _set_bits(tied)
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    fits = nth < (k - count(sure)[:, 0])[row]
    more = _set_bits(sure)
    row, place = np.concatenate([more[0], row[fits]]), np.concatenate([more[1], place[fits]])
    word, bit = place >> 6, (place & 63).astype(np.uint64)
    score = sum(((p[row, word] >> bit) & np.uint64(1)).astype(np.int64) << i for i, p in enumerate(planes))
    return row, place, score


class _Asked(blocks.Best):
    """A block of questions, and the first k documents of each so far."""

    def __init__(self, ids: bytes, words: bytes, begins: bytes, places: bytes, k: int) -> None:
        super().__init__(np.frombuffer(ids, np.int64), k)
        self.words, self.begins, self.places = np.frombuffer(words, np.int64), np.frombuffer(begins, np.int32), np.frombuffer(places, np.uint16).astype(np.int64)

    def meet(self, docs: np.ndarray, words: np.ndarray, begins: np.ndarray, places: np.ndarray) -> None:
        """Ranks a block of documents with what there is."""
        k = self.score.shape[1]
        _, mine, theirs = np.intersect1d(self.words, words, assume_unique=True, return_indices=True)
        if not len(mine):
            return
        width = -(-len(docs) // 64)
        bits = np.zeros((len(mine) + 1, width * 8), np.uint8)  # the last row is empty
        held, size = blocks.spans(begins, theirs)
        at = places[held].astype(np.int64)
        np.add.at(bits.reshape(-1), np.repeat(np.arange(len(mine)), size) * (width * 8) + (at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
        bits = bits.view(np.uint64)

        held, many = blocks.spans(self.begins, mine)
        question = self.places[held]
        order = np.argsort(question, kind="stable")
        row = np.repeat(np.arange(len(mine)), many)[order]
        n = np.bincount(question, minlength=len(self.ids))  # the most that a document of this block can reach
        start = np.append(0, np.cumsum(n)[:-1])
        least, before = self.score[:, -1].astype(np.int64), np.searchsorted(docs, self.doc[:, -1])
        open_ = np.flatnonzero((n > least) | ((n == least) & (n > 0) & (before > 0)))
        open_ = open_[np.argsort(n[open_], kind="stable")]
        found = []
        for a in range(0, len(open_), TOGETHER):
            q = open_[a : a + TOGETHER]
            j = np.arange(n[q].max())
            rows = np.where(j < n[q][:, None], row[np.minimum(start[q][:, None] + j, len(row) - 1)], len(mine))
            planes = _planes(bits, rows)
            among = _beyond(planes, least[q], before[q])
            some = np.flatnonzero(among.any(axis=1))
            if len(some):
                r, place, score = _first([p[some] for p in planes], among[some], k)
                found.append((q[some][r], docs[place], score))
        if found:
            self.merge(*(np.concatenate(x) for x in zip(*found, strict=True)))


def most_shared(docs: DataFrame, questions: DataFrame, k: int, per_block: tuple[int, int] = (blocks.DOCS, blocks.QUESTIONS)) -> DataFrame:
    """docs(doc_id, text), questions(q_id, text) -> (q_id, doc_id, score, rank): the first k documents by the number of distinct words
    shared with the question, then by id. Documents and questions without an id take no part; who shares no word isn't found."""
    asked = stored(_words(questions, "q_id", F.col("text")), "asked")
    words = stored(asked.select("term").distinct().withColumn("word", F.monotonically_increasing_id()), "words")
    known = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    numbered = lambda rows: rows.join(known, "term").select("id", "word")
    left = stored_blocks(packed(numbered(_words(docs, "doc_id", F.col("text"))), docs.count(), per_block[0]), "blocks").coalesce(blocks.PARTS)
    right = stored_blocks(packed(numbered(asked), asked.select("id").distinct().count(), per_block[1]), "questions").select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "words", "begins", "places")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_by: dict[bytes, _Asked] = {}  # of this task's questions
        kinds = (np.int64, np.int64, np.int32, np.uint16)
        for b in batches:
            for i in range(b.num_rows):
                d, q = ([b.column(c)[i].as_buffer() for c in range(f, f + 4)] for f in (0, 4))
                key = q[0].slice(0, 8).to_pybytes()  # a question is in one block only
                if key not in asked_by:
                    asked_by[key] = _Asked(*(x.to_pybytes() for x in q), k)
                asked_by[key].meet(*(np.frombuffer(x, t) for x, t in zip(d, kinds, strict=True)))
        for x in asked_by.values():
            yield x.rows()

    return top(stored_blocks(left.crossJoin(right).mapInArrow(run, "q_id long, doc_id long, score double"), "hits"), k, ["q_id"])
