"""Harmonic packing of token sequences.

A document's ids (an end id after them) are cut: whole pieces of the capacity first; what is left falls into the
reciprocal class k with capacity/(k+1) < length <= capacity/k, if k such pieces fill a sequence up to SLACK; otherwise
a piece of exactly capacity/(k+1) is cut off and the rest is looked at again. A sequence of class k holds exactly k
pieces, so workers fill the classes without knowing each other: each numbers its own pieces of a class, and one small
table of counts (worker, class) tells it where its numbers begin. At most one sequence of each class stays short;
those few (a number that the capacity bounds) are merged first-fit by falling size.

Defined results: null text counts as empty and still has its end id; a null id is packed like others; rows are packed
one by one, repeated or not; an empty table gives no rows. A single text must fit a task's memory. Texts go through
the tokenizer in small groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import join_small, written
from .text import ranges, release, span_hashes

CAPACITY, END_ID, SLACK = 2048, 1, 0.02
TOKENIZER = "word_bpe_49k.json"
_GROUP_BYTES = 1 << 18


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_CLASS = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other
for _b in range(256):
    if _b in (9, 10, 13, 32):
        _CLASS[_b] = 0
    elif chr(_b).isalpha() and _b < 128 or _b >= 128:
        _CLASS[_b] = 1
    elif 48 <= _b <= 57:
        _CLASS[_b] = 2


_ODD = np.zeros(256, bool)  # bytes that the shortcut doesn't take; 0xC3 begins the letters it does
_ODD[[b for b in range(256) if b < 32 and _CLASS[b] or b == 127 or b >= 0xC0 and b != 0xC3]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SHORT = np.zeros(256, bool)  # begins what may follow an apostrophe in a contraction
_SHORT[[ord(c) for c in "stmdrvlSTMDRVL"]] = True


#: Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on.
_AS_CHAR = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Coder:
    """ids of texts by a word-level tokenizer. The ids of a word stay at a place given by its hash until another word takes that
    place, so the cache is bounded and holds the frequent words; what is returned doesn't depend on it.

    Texts of plain ASCII and the letters of U+00C0 to U+00FF are cut into words as the tokenizer does (runs of
    letters, single digits, runs of other marks), and words are told apart by 64-bit hashes. Any other text, and one with
    a contraction or a special token's opening, goes through the tokenizer whole.
    """

    #: Places, and ids from which the pool is packed before the next texts.
    SLOTS, MOST_IDS = 1 << 19, 3 << 20

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: the shortcut holds for tokenizers that code lower-cased words one by one, as bytes
        probe = "a1 bc. the élan, Ñandú ßtraße—Àþÿ Über20"
        words = ["a", "1", "bc", ".", "the", "élan", ",", "ñandú", "ßtraße", "àþÿ", "über", "2", "0"]
        self.forget()
        self.by_words = self.whole([probe.replace("—", " ")])[0].tolist() == self.pool[: self.learn([w.encode() for w in words])[1].sum()].tolist()
        self.forget()

    def forget(self) -> None:
        self.key, self.at, self.size = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.int32)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def tidy(self) -> None:
        """Keeps in the pool only ids of words that still have a place; if those are most of it, begins anew."""
        held = np.flatnonzero(self.size)
        size = self.size[held].astype(np.int64)
        if size.sum() > self.MOST_IDS // 4 * 3:
            return self.forget()
        self.pool = self.pool[ranges(self.at[held].astype(np.int64), size)]
        self.at[held], self.used = np.cumsum(size) - size, len(self.pool)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of new words begin, and how many they are; the model takes the words' bytes as characters."""
        code = self.model.tokenize
        coded = [[t.id for t in code(w.decode() if w.isascii() else w.decode("latin-1").translate(_AS_CHAR))] for w in words]
        count = np.array([len(c) for c in coded], np.int64)
        at, self.used = self.used, self.used + int(count.sum())
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(at // 2, self.used - at), np.uint32)])
        self.pool[at : self.used] = np.fromiter(chain.from_iterable(coded), np.uint32, self.used - at)
        return at + np.cumsum(count) - count, count

    def places(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each word of low begin, and how many they are."""
        if self.used > self.MOST_IDS:
            self.tidy()
        hashes = span_hashes(low, starts, ends)
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        missed = np.flatnonzero((self.key[slot] != hashes) | (size == 0))
        if len(missed):
            new, first, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            first, raw = missed[first], low.tobytes()
            where, count = self.learn([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            at[missed], size[missed] = where[inverse], count[inverse]
            _, owner = np.unique(slot[first], return_index=True)  # one of the words that come to the same place
            self.key[slot[first[owner]]], self.at[slot[first[owner]]], self.size[slot[first[owner]]] = new[owner], where[owner], count[owner]
        return at, size

    def code(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        after = lambda b: np.flatnonzero(data[:-1] == b) + 1
        accents, openings, quotes = after(0xC3), after(0x3C), after(0x27)
        odd = [np.flatnonzero(_ODD[data]), accents[(data[accents] == 0x97) | (data[accents] == 0xB7)], openings[data[openings] == 0x7C], quotes[_SHORT[data[quotes]]]]
        strange = np.zeros(len(texts), bool)
        strange[np.searchsorted(offsets, np.concatenate(odd), "right") - 1] = True
        if not self.by_words:
            strange[:] = True
        some = np.flatnonzero(strange)
        for i, ids in zip(some, self.whole([texts[i] for i in some]), strict=True):
            out[i] = ids
        low = _LOW[data]
        low[accents[data[accents] <= 0x9E]] += 32
        kind = _CLASS[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        keep = kind[cuts[:-1]] != 0
        if len(some):
            keep &= ~strange[np.searchsorted(offsets, cuts[:-1], "right") - 1]
        starts, ends = cuts[:-1][keep], cuts[1:][keep]
        at, sizes = self.places(low, starts, ends)
        ids = self.pool[ranges(at, sizes)]
        word_edge = np.searchsorted(starts, offsets)
        ends_at = np.concatenate([[0], np.cumsum(sizes)])[word_edge]
        for i in np.flatnonzero(~strange):
            out[i] = ids[ends_at[i] : ends_at[i + 1]]
        return out


@lru_cache(maxsize=2)
def _coder(path: str) -> Coder:
    return Coder(path)


@lru_cache(maxsize=100_000)
def cut_rest(rest: int, capacity: int = CAPACITY, slack: float = SLACK) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of fewer than `capacity` ids."""
    out = []
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity or k >= capacity // 32:
            out.append((rest, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, k + 1))
        rest -= piece
    return tuple(out)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    return [(capacity, 1)] * (length // capacity) + list(cut_rest(length % capacity, capacity))


def _piece_batches(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, worker, seen = _coder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                group, size = [], 0
                while at + len(group) < len(ids) and (not group or size < _GROUP_BYTES):
                    group.append(texts[at + len(group)].as_py() or "")
                    size += len(group[-1])
                unique = {t: i for i, t in enumerate(dict.fromkeys(group))}
                coded = [np.append(x, np.uint32(end_id)).astype("<u4") for x in coder.code(list(unique))]
                rows = []
                for i, text in enumerate(group):
                    tokens, start = coded[unique[text]], 0
                    for length, k in cut(len(tokens), capacity):
                        raw = tokens[start : start + length].tobytes()
                        rows.append((ids[at + i], start, length, zlib.crc32(raw), len(tokens), worker, k, seen.get(k, 0), *([raw] if with_ids else [])))
                        seen[k] = seen.get(k, 0) + 1
                        start += length
                at += len(group)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "worker", "k", "nth", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names[: 8 + with_ids])
        release()

    return run


def first_fit(sizes: dict[int, int], capacity: int) -> dict[int, int]:
    """Bins of at most `capacity` for the items, largest first."""
    room: list[int] = []
    out = {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = next((i for i, r in enumerate(room) if r >= size), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= size
        out[item] = at
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids as little-endian
    unsigned 32-bit bytes if asked for)."""
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, k int, nth long" + ", ids binary" * with_ids
    pieces = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_piece_batches(path or tokenizer_path(), capacity, end_id, with_ids), schema), "pieces")
    counts = pieces.groupBy("k", "worker").count()
    before = written(counts.select("k", "worker", (F.sum("count").over(Window.partitionBy("k").orderBy("worker")) - F.col("count")).alias("before"), "count"), "offsets")
    totals = {r.k: r.n for r in before.groupBy("k").agg(F.sum("count").alias("n")).collect()}  # one row a class: at most `capacity`
    base, at = {}, 0
    for k in sorted(totals):
        base[k], at = at, at + totals[k] // k
    placed = join_small(pieces, before.select("k", "worker", "before"), ["k", "worker"], "inner").withColumn("nth", F.col("nth") + F.col("before")).drop("before", "worker")
    spark = docs.sparkSession
    classes = spark.createDataFrame([(k, base[k], totals[k] // k * k) for k in totals], "k int, base long, whole long")
    placed = placed.join(F.broadcast(classes), "k")
    tail = {r.k: r.size for r in placed.where("nth >= whole").groupBy("k").agg(F.sum("length").alias("size")).collect()}
    bins = spark.createDataFrame([(k, at + b) for k, b in first_fit(tail, capacity).items()], "k int, bin long")
    placed = placed.join(F.broadcast(bins), "k", "left").withColumn("sequence_id", F.expr("CASE WHEN nth < whole THEN base + nth div k ELSE bin END"))
    in_order = Window.partitionBy("sequence_id").orderBy("k", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(in_order) - F.col("length")).alias("offset"), *(["ids"] if with_ids else []))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
