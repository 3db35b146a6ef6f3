"""Language identification: averaged embeddings of hashed subwords, a linear softmax on top, calibrated rejection.

A text's words are its runs of letters (ASCII ones, lower-cased, and all bytes from 128 on). The subwords of a word are its
byte runs of SIZES lengths between boundary marks, and the word itself; each is hashed to one of BUCKETS embeddings. A text is the
mean of its subwords' embeddings, whatever its length. Embeddings and softmax are trained together by stochastic gradient
descent in NumPy on at most SAMPLE documents (ids chosen by a hash), of which every fifth is kept for calibration: it sets
the temperature of the softmax and the score from which predictions are right often enough (PRECISION) to be accepted.

Since the softmax is linear, a subword adds fixed numbers to the languages' sums: they are found once for each distinct word of a block
and added up at its places. All rows are scored in one pass without a shuffle.

Defined results: a text that is null or has no letter is `und` with score 0 and not accepted; learning uses rows with an id and a
non-null lang; an id on several rows counts once, with its least lang and text; one language only is predicted with score 1; without rows to learn
from all is `und`; other columns are kept, those named as the outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import _LETTER, _LOWER, of_text
from .quality import held_out_fold
from .storage import written
from .text import blocks, mix, ranges, span_hashes

SAMPLE, BUCKETS, WIDTH = 3_000, 1 << 15, 16
SIZES = (2, 3, 4, 5)
PRECISION = 0.99
UNKNOWN = "und"
_STEP = 0x9E3779B97F4A7C15


class Subwords:
    """The subwords of the distinct words of some rows: `bucket` of each and the distinct `word` it belongs to; `row` and `code`
    tell which distinct word stands at each place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        letter = _LETTER[data]
        begin, end = letter.copy(), letter.copy()
        begin[1:] &= ~letter[:-1]
        end[:-1] &= ~letter[1:]
        heads, tails = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
        begin[heads], end[tails] = letter[heads], letter[tails]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.rows, self.row, low = len(offsets) - 1, np.searchsorted(offsets, starts, "right") - 1, _LOWER[data]
        hashes = span_hashes(low, starts, ends)
        distinct, first, self.code = np.unique(hashes, return_index=True, return_inverse=True)
        size = ends[first] - starts[first]
        self.words = len(size)
        # each distinct word between two marks
        edges = np.concatenate([[0], np.cumsum(size + 2)])
        marked = np.full(int(edges[-1]) + 8, ord(" "), np.uint8)
        marked[ranges(edges[:-1] + 1, size)] = low[ranges(starts[first], size)]
        limbs = np.ndarray((len(marked) - 7,), np.uint64, marked, strides=(1,))
        buckets, words = [distinct], [np.arange(self.words)]
        for n in SIZES:
            count = np.maximum(size + 3 - n, 0)
            at = ranges(edges[:-1], count)
            buckets.append(mix((limbs[at] & np.uint64((1 << 8 * n) - 1)) + np.uint64(n * _STEP & 0xFFFFFFFFFFFFFFFF)))
            words.append(np.repeat(np.arange(self.words), count))
        self.bucket = (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.word = np.concatenate(words)

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per row: its buckets and the share of the row's subwords in each."""
        order = np.argsort(self.word, kind="stable")
        bucket, edge = self.bucket[order], np.concatenate([[0], np.cumsum(np.bincount(self.word, minlength=self.words))]).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=self.rows))]).astype(np.int64)
        for r in range(self.rows):
            code, times = np.unique(self.code[places[r] : places[r + 1]], return_counts=True)
            n = edge[code + 1] - edge[code]
            seen = np.bincount(bucket[ranges(edge[code], n)], np.repeat(times, n), BUCKETS)
            found = np.flatnonzero(seen)
            yield found.astype(np.int32), (seen[found] / max(1.0, seen.sum())).astype(np.float32)

    def means(self, table: np.ndarray) -> np.ndarray:
        """Per row the mean of its subwords' rows of table(BUCKETS x k); zeros without subwords."""
        out = np.zeros((self.rows, table.shape[1]))
        if len(self.row):
            total = np.bincount(self.row, np.bincount(self.word, minlength=self.words)[self.code], self.rows)
            for k in range(table.shape[1]):
                of_word = np.bincount(self.word, table[self.bucket, k], self.words)
                out[:, k] = np.bincount(self.row, of_word[self.code], self.rows) / np.maximum(total, 1)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 20, batch: int = 32, rate: float = 40.0, seed: int = 11) -> np.ndarray:
    """BUCKETS x classes: what each subword adds to a language's sum. rows: buckets and shares of each document."""
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, classes), np.float32), np.zeros(classes, np.float32)
    steps, done = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            some = order[lo : lo + batch]
            x = np.zeros((len(some), BUCKETS), np.float32)
            for i, r in enumerate(some):
                x[i, rows[r][0]] = rows[r][1]
            hidden = x @ embedding
            wrong = softmax(hidden @ weights + bias)
            wrong[np.arange(len(some)), y[some]] -= 1
            step = rate * (1 - done / steps) / len(some)
            back = wrong @ weights.T
            weights -= np.float32(step / 8) * (hidden.T @ wrong)
            bias -= np.float32(step / 80) * wrong.sum(0)
            embedding -= np.float32(step) * (x.T @ back)
            done += 1
    return (embedding @ weights + bias).astype(np.float64)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What to divide by so that the softmax is as likely as can be; one row more of each language, wrongly labelled, is assumed, so
    that a few rows that are all right don't make every score 1."""
    n, k = logits.shape if len(y) else (0, 0)
    if not n:
        return 1.0
    wanted = np.full((n, k), 1 / (n + k))
    wanted[np.arange(n), y] += n / (n + k)
    loss = lambda t: -(wanted * np.log(softmax(logits / t) + 1e-12)).sum(1).mean()
    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def accept_from(score: np.ndarray, right: np.ndarray, precision: float = PRECISION) -> float:
    """The least score from which on at least that share of the predictions is right; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(score[order]) != 0, True) if len(order) else np.zeros(0, bool)  # ties are taken together
    good = np.flatnonzero((share >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else 2.0


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    heat: float = 1.0
    least: float = 0.0

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x (number of the language, score)."""
        p = softmax(Subwords(data, offsets).means(self.table) / self.heat)
        return np.stack([p.argmax(1).astype(float), p.max(1)], 1)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = (batch.column(batch.schema.get_field_index(c)) for c in ("lang", "text"))
        for at, n, data, offsets in blocks(text):
            rows = list(Subwords(data, offsets).counts())
            yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array([b.tobytes() for b, _ in rows], pa.binary()), pa.array([s.tobytes() for _, s in rows], pa.binary())], names=["lang", "buckets", "shares"])


def learning_sample(docs: DataFrame, held_out: Column, id_col: str, lang_col: str, text_col: str, rows: int = SAMPLE) -> DataFrame:
    """(id, lang, text) of at most `rows` ids that aren't held out, chosen by a hash. Only ids are counted and sorted, and of
    those only about as many as are wanted."""
    able = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out)
    n, space = able.count(), 1 << 30
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(space))
    near = able.where(place < int(space * min(1.0, (1.5 * rows + 100) / max(n, 1))))
    chosen = near.select(id_col).distinct().orderBy(place, id_col).limit(rows)
    found = near.join(F.broadcast(chosen), id_col)  # `rows` ids at most
    return written(found.groupBy(id_col).agg(F.min(F.struct(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).alias("x")).select(F.col(id_col).alias("id"), "x.*"), "sample")


def fit(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", rows: int = SAMPLE) -> LanguageModel:
    held_out = F.lit(False) if held_out is None else held_out
    sample = learning_sample(docs, held_out, id_col, lang_col, text_col, rows)
    got = sample.repartition(max(1, rows // 200), "id").select("id", "lang", "text").sortWithinPartitions("id").select("lang", "text").mapInArrow(_count_batches, "lang string, buckets binary, shares binary").toArrow()
    lang = got.column("lang").to_pylist()  # at most `rows` rows of at most BUCKETS numbers
    pairs = [(np.frombuffer(b.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.float32)) for b, s in zip(got.column("buckets"), got.column("shares"), strict=True)]
    some = [i for i, p in enumerate(pairs) if len(p[0])]
    languages = sorted({lang[i] for i in some})
    if not some:
        return LanguageModel([], np.zeros((BUCKETS, 1)))
    if len(languages) == 1:
        return LanguageModel(languages, np.zeros((BUCKETS, 1)))
    y = np.array([languages.index(lang[i]) for i in some])
    pairs = [pairs[i] for i in some]
    aside = np.arange(len(y)) % 5 == 4
    table = train([p for p, a in zip(pairs, aside, strict=True) if not a], y[~aside], len(languages))
    logits = np.array([(table[b] * s[:, None]).sum(0) for (b, s), a in zip(pairs, aside, strict=True) if a]).reshape(-1, len(languages))
    heat = temperature(logits, y[aside])
    p = softmax(logits / heat) if len(logits) else np.zeros((0, len(languages)))
    return LanguageModel(languages, table, heat, accept_from(p.max(1), p.argmax(1) == y[aside]) if len(p) else 0.0)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and accepted."""
    made = of_text(model.predict, T.ArrayType(T.DoubleType()))
    found = docs.withColumn("__found", made(F.col(text_col)))
    known = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    names = F.array(*(F.lit(x) for x in model.languages or [UNKNOWN]))
    pred = F.when(known, F.get(names, F.col("__found")[0].cast("int"))).otherwise(UNKNOWN)
    score = F.when(known, F.col("__found")[1]).otherwise(0.0)
    return found.withColumns({"lang_pred": pred, "score": score, "accepted": known & (F.col("__found")[1] >= model.least)}).drop("__found")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = held_out_fold("doc_id", 3, 1)
    model = fit(docs, held)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
