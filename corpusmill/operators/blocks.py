"""Blocks of documents and of questions, packed by word, and the first k documents of each question while blocks meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents and questions in a block (16 bits count them), and the rows that are held at most until a block is cut.
DOCS, QUESTIONS, ROWS = 16_384, 4_096, 4_000_000
#: Parts of the documents that rank on their own before they are merged.
PARTS = 8
NONE = np.iinfo(np.int64).max


def edges(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column; the first row does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def cut(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first column, an id -> the same rows in runs of up to `size` ids; about `rows` are held, and an id stays whole."""
    held: list[list[np.ndarray]] = []

    def runs(last: bool) -> Iterator[list[np.ndarray]]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        starts = np.flatnonzero(edges(columns[0]))
        ends = np.append(starts[size::size], len(columns[0]) if last else starts[-1])
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            if b > a:
                yield [c[a:b] for c in columns]
        held[:] = [[c[ends[-1] :] for c in columns]]

    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy() for c in b.columns])
            if sum(len(x[0]) for x in held) >= rows:
                yield from runs(False)
    if held:
        yield from runs(True)


def row(*columns: np.ndarray, names: str) -> pa.RecordBatch:
    """One row of packed columns."""
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=names.split())


def spans(begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the entries that each of `which` has, one after the other, and how many they are; begins has one more at its end."""
    size = begins[which + 1] - begins[which]
    return np.arange(size.sum()) + np.repeat(begins[which] - (np.cumsum(size) - size), size), size


class Best:
    """The first k documents of each question of a block so far: by score, then by id; scores are over 0."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.score, self.doc = ids, np.zeros((len(ids), k)), np.full((len(ids), k), NONE)

    def merge(self, q: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Takes rows in, q: places in ids."""
        who = np.unique(q)
        old = np.nonzero(self.score[who] > 0)
        q, doc, score = np.concatenate([who[old[0]], q]), np.concatenate([self.doc[who][old], doc]), np.concatenate([self.score[who][old], score])
        order = np.lexsort((doc, -score, q))
        q, doc, score = q[order], doc[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        first = nth < self.score.shape[1]
        self.score[who], self.doc[who] = 0, NONE
        self.score[q[first], nth[first]], self.doc[q[first], nth[first]] = score[first], doc[first]

    def rows(self) -> pa.RecordBatch:
        at, nth = np.nonzero(self.score > 0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[at], self.doc[at, nth], self.score[at, nth])], names=["q_id", "doc_id", "score"])
