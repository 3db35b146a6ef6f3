"""Phrase collocation mining: each language's best phrases of 2 to LONGEST words, found by best-first branch and bound.

Phrases grow from their first word. A phrase that begins with w scores at most floor(1000 n / f(w)): its first cut has l = f(w)
and r >= a. So the frontier holds the words, those with the best bounds (the rarest) come first, and a language is settled as
soon as `top` surviving phrases score more than the bound of every word not yet expanded; ties with the last one are then
among those found. Languages that have fewer phrases end with all words expanded. The frontier moves in at most
len(SHARES) steps: a step takes the rarest words that together make up the next share of a language's occurrences.

A step grows its words' phrases a word at a time over the whole corpus: a phrase is counted only if its beginning is frequent.
Counts of the rests of its phrases that begin with a word not yet expanded are counted on demand, only for phrases whose
cuts known so far beat the bound. Filters for "is frequent", "is expanded", "is asked for" are bitmaps of bounded
size (see `bitmap`); a false positive costs a counted row, never a result.

A phrase is dropped if a longer candidate has its count; as counts only fall with length, that is so exactly if all its
places have the same word before them, or all the same word after them, in their piece. Both are kept with the counts.

Texts are read twice: for the words, and to encode them as 64-bit numbers (frequent words only, others part the runs). No two words
of which one is frequent share a number: that is checked, and another salt is taken if they do.

Defined results: null text counts as empty, null lang as `und` (together with rows whose lang is that); each row counts, repeated
ones and those without an id too; a language without phrases of LEAST places has no rows; an empty table gives none; other
columns are ignored. Arithmetic is exact: decimals of 38 digits hold 1000 * a * n for counts up to 10^17.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import Bitmap
from .features import _LOWER
from .storage import written
from .text import blocks, mix, ranges, span_hashes

LEAST, TOP, LONGEST = 100, 2000, 5
#: Shares of a language's occurrences that the rarest words of each step make up.
SHARES = (1 / 64, 1 / 16, 1 / 4, 1)
#: A step has so many occurrences at least: below that, one more pass costs more than it saves.
LEAST_STEP = 2_000_000
_W = [f"w{i}" for i in range(1, LONGEST + 1)]
_PHRASE = ", ".join(f"{w} long" for w in _W) + ", n long, before_min long, before_max long, after_min long, after_max long"
_GAP = np.isin(np.arange(256), [0x20, 0x09])
_BREAK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D])
#: Places that are counted at once in a task.
CHUNK = 1 << 17
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def phrase_hash(columns: list[np.ndarray]) -> np.ndarray:
    """What F.xxhash64 gives for these columns of longs."""
    h = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        h = h + _P5 + np.uint64(8)
        h ^= _rotated(c.view(np.uint64) * _P2, 31) * _P1
        h = _rotated(h, 27) * _P1 + _P4
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def _words(langs: pa.Array, data: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, row, number, is a piece's first) of the words of a block of texts."""
    low = _LOWER[data]
    stop = _BREAK[data]
    part = _GAP[data] | stop
    begin, end = ~part, ~part
    begin[1:] &= part[:-1]
    end[:-1] &= part[1:]
    heads, tails = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    begin[heads], end[tails] = ~part[heads], ~part[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    codes = langs.dictionary_encode()
    names = [x.encode() for x in codes.dictionary.to_pylist()]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int64)
    seeds = span_hashes(np.frombuffer(b"".join(names), np.uint8), edge[:-1], edge[1:])
    seed = mix(seeds + np.uint64(salt + 1))[codes.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    number = mix(span_hashes(low, starts, ends) ^ seed[row])
    number[number == 0] = 1
    breaks = np.concatenate([[0], np.cumsum(stop)])[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (np.diff(breaks) > 0) | (np.diff(row) > 0)
    return low, starts, ends, row, number, first


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    return batch.column(batch.schema.get_field_index("lang")), batch.column(batch.schema.get_field_index("text"))


def _word_batches(salt: int):
    """(lang, text) -> (lang, word, number, n), each word once a block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = _columns(batch)
            for at, n, data, offsets in blocks(texts, 1 << 20):
                mine = langs.slice(at, n)
                low, starts, ends, row, number, _ = _words(mine, data, offsets, salt)
                number, first, count = np.unique(number, return_index=True, return_counts=True)
                size = ends[first] - starts[first]
                edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                word = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(edges), pa.py_buffer(low[ranges(starts[first], size)])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(row[first])), word, pa.array(number.view(np.int64)), pa.array(count)], names=["lang", "word", "h", "n"])

    return run


def _encoded_batches(salt: int, frequent):
    """(lang, text) -> runs of the numbers of frequent words inside pieces, each run after a zero; single words are left out. A row holds
    a block of texts: its distinct numbers, and which of them stands at each place (in two bytes if there are few enough)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            langs, texts = _columns(batch)
            words, codes = [], []
            for at, n, data, offsets in blocks(texts, 1 << 20):
                *_, number, first = _words(langs.slice(at, n), data, offsets, salt)
                place = np.arange(len(number)) + np.cumsum(first)
                seq = np.zeros(len(number) + int(first.sum()) + 2, np.uint64)
                seq[place] = np.where(known.has(number), number, 0)
                some = seq != 0
                some[1:-1] &= (seq[:-2] != 0) | (seq[2:] != 0)
                keep = some.copy()
                keep[:-1] |= (seq[:-1] == 0) & some[1:]
                distinct, code = np.unique(np.where(some, seq, 0)[keep], return_inverse=True)
                if len(code):
                    words.append(distinct.tobytes())
                    codes.append(code.astype(_code_type(len(distinct))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(codes, pa.binary())], names=["words", "codes"])

    return run


def _code_type(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for w, c in zip(batch.column(0), batch.column(1), strict=True):
            words = np.frombuffer(w.as_buffer(), np.int64)
            yield np.concatenate([words[np.frombuffer(c.as_buffer(), _code_type(len(words)))], np.zeros(LONGEST + 1, np.int64)])


def _counted(seqs: list[np.ndarray], places: list[np.ndarray], m: int) -> pa.RecordBatch:
    """Rows of _PHRASE for the phrases of m words at some places of some sequences."""
    words = [np.concatenate([s[p + i] for s, p in zip(seqs, places, strict=True)]) for i in range(m)]
    before = np.concatenate([np.where(p > 0, s[p - 1], 0) for s, p in zip(seqs, places, strict=True)])
    after = np.concatenate([s[p + m] for s, p in zip(seqs, places, strict=True)])
    order = np.argsort(phrase_hash(words), kind="stable")
    words, before, after = [w[order] for w in words], before[order], after[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([w[1:] != w[:-1] for w in words], axis=0)  # by the words: phrases of one hash stay apart
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(order)))
    edges = [f.reduceat(x, at) if len(at) else x for x in (before, after) for f in (np.minimum, np.maximum)]
    columns = [*(w[at] for w in words), *[np.zeros(len(at), np.int64)] * (LONGEST - m), n, *edges]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_W, "n", "before_min", "before_max", "after_min", "after_max"])


def _count_batches(lengths: tuple[int, ...], wanted):
    """Encoded runs -> counts of the phrases of these lengths for which wanted(sequence, places, length) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {m: ([], []) for m in lengths}
        for seq in _runs(batches):
            inside = seq != 0
            for m in lengths:
                full = inside[: len(seq) - LONGEST].copy()
                for i in range(1, m):
                    full &= inside[i : len(seq) - LONGEST + i]
                places = wanted(seq, np.flatnonzero(full), m)
                if len(places):
                    held[m][0].append(seq)
                    held[m][1].append(places)
                    if sum(map(len, held[m][1])) > CHUNK or sum(map(len, held[m][0])) > 4 * CHUNK:
                        yield _counted(*held[m], m)
                        held[m] = ([], [])
        for m, (seqs, places) in held.items():
            if seqs:
                yield _counted(seqs, places, m)

    return run


def _grows(expanded, frequent):
    """Phrases whose first word is expanded now and whose beginning and, if its first word is expanded now too, rest are frequent."""

    def wanted(seq: np.ndarray, places: np.ndarray, m: int) -> np.ndarray:
        places = places[expanded.value.has(seq[places])]
        if frequent is not None:
            places = places[frequent.value.has(phrase_hash([seq[places + i] for i in range(m - 1)]))]
            rest = frequent.value.has(phrase_hash([seq[places + i] for i in range(1, m)]))
            places = places[rest | ~expanded.value.has(seq[places + 1])]
        return places

    return wanted


def _asked(known: dict):
    def wanted(seq: np.ndarray, places: np.ndarray, m: int) -> np.ndarray:
        return places[known[m].value.has(phrase_hash([seq[places + i] for i in range(m)]))]

    return wanted


def _summed(runs: DataFrame, lengths: tuple[int, ...], wanted) -> DataFrame:
    found = runs.mapInArrow(_count_batches(lengths, wanted), _PHRASE)
    return found.groupBy(*_W).agg(F.sum("n").alias("n"), F.min("before_min").alias("before_min"), F.max("before_max").alias("before_max"), F.min("after_min").alias("after_min"), F.max("after_max").alias("after_max"))


def _vocabulary(texts: DataFrame, least: int) -> tuple[int, DataFrame, DataFrame]:
    """(salt, words(lang, word, h, n) of `least` places or more, totals(lang, total))."""
    for salt in itertools.count():
        words = written(texts.mapInArrow(_word_batches(salt), "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "words")
        clash = words.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).where((F.col("c") > 1) & (F.col("n") >= least))
        if not clash.limit(1).count():
            return salt, written(words.where(F.col("n") >= least), "frequent"), written(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")


def _steps(words: DataFrame, least_step: int) -> DataFrame:
    """words with `step`: at which step of the frontier each is expanded, the rarest (by powers of two) of a language first; a
    step takes least_step occurrences or more."""
    power = F.floor(F.log2("n")).cast("int")
    sums = words.groupBy("lang", power.alias("power")).agg(F.sum("n").alias("n"))  # a few dozen rows a language
    so_far, total = F.sum("n").over(Window.partitionBy("lang").orderBy("power")), F.sum("n").over(Window.partitionBy("lang"))
    lowest = F.col("power") == F.min("power").over(Window.partitionBy("lang"))
    step = F.coalesce(*(F.when(so_far <= F.greatest(total * s, F.lit(least_step)), F.lit(i)) for i, s in enumerate(SHARES)), F.lit(len(SHARES) - 1))
    steps = sums.select("lang", "power", F.when(lowest, F.lit(0)).otherwise(step).alias("step"))
    return words.withColumn("power", power).join(steps, ["lang", "power"]).drop("power")


def _cuts(phrases: DataFrame) -> DataFrame:
    """A row a cut: the phrase's words, k, and the words of its first part (l1..) and its rest (r1..), zeros behind."""
    parts = F.array(*_W)
    size = F.size(F.filter(parts, lambda x: x != 0))
    rows = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    first = [F.when(F.col("k") >= i, F.col(f"w{i}")).otherwise(F.lit(0).cast("long")).alias(f"l{i}") for i in range(1, LONGEST)]
    rest = [F.coalesce(F.get(parts, F.col("k") + (i - 1)), F.lit(0).cast("long")).alias(f"r{i}") for i in range(1, LONGEST)]
    return rows.select("*", *first, *rest)


def _with_count(cuts: DataFrame, counts: DataFrame, side: str) -> DataFrame:
    keys = [f"{side}{i}" for i in range(1, LONGEST)]
    return cuts.join(counts.select(*(F.col(w).alias(c) for w, c in zip(_W, keys, strict=False)), F.col("n").alias(side)), keys, "left")


#: floor(1000 a n / (l r)), exactly.
_SCORE = "(cast(1000 AS decimal(38,0)) * cast(a AS decimal(38,0)) * cast(total AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0)))"
_GROUP = ["lang", "total", *_W, "a"]


def _grown(runs: DataFrame, now: DataFrame, least: int) -> DataFrame:
    """Counts of the frequent phrases that begin with a word of now(h, lang, total): lang, total and the columns of _PHRASE."""
    share = runs.sparkSession.sparkContext.broadcast
    expanded, frequent, levels = share(Bitmap.of(now, "h")), None, []
    for m in range(2, LONGEST + 1):
        level = written(_summed(runs, (m,), _grows(expanded, frequent)).where(F.col("n") >= least), "phrases")
        if not level.limit(1).count():
            break
        levels.append(level)
        frequent = share(Bitmap.of(level.select(F.xxhash64(*_W[:m]).alias("h")), "h"))
    rows = levels[0] if levels else level
    for level in levels[1:]:
        rows = rows.union(level)
    return rows.join(now.select(F.col("h").alias("w1"), "lang", "total"), "w1").select("lang", "total", *_W, "n", "before_min", "before_max", "after_min", "after_max")


def _best_cuts(runs: DataFrame, phrases: DataFrame, counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Those of phrases(_GROUP) that score more than their language's bound, with l, r and score of their lowest cut."""
    cuts = _with_count(_with_count(_cuts(phrases), counts, "l"), counts, "r").withColumn("score", F.expr(_SCORE))
    rest = [f"r{i}" for i in range(1, LONGEST)]
    lists = cuts.groupBy(*_GROUP).agg(F.collect_list(F.struct("score", "k", "l", "r", *rest)).alias("cuts"))  # LONGEST - 1 at most
    beats = lambda c: F.col(c) > F.col("bound")
    # a cut whose rest isn't counted yet has no score, and array_min passes over it
    lists = lists.join(bounds, "lang").withColumn("least", F.array_min(F.transform("cuts", lambda c: c["score"]))).where(beats("least"))
    lists = written(lists, "cuts")
    each = lists.select(*_GROUP, "bound", F.explode("cuts").alias("c")).select(*_GROUP, "bound", "c.*")
    missing = written(each.where("r IS NULL").select(*rest).distinct(), "missing")
    lengths = [m for m in range(2, LONGEST) if missing.where(F.col(f"r{m}") != 0).where(F.col(f"r{m + 1}") == 0 if m + 1 < LONGEST else F.lit(True)).limit(1).count()]
    if lengths:
        known = {}
        for m in lengths:
            mine = missing.where(F.col(f"r{m}") != 0).where(F.col(f"r{m + 1}") == 0 if m + 1 < LONGEST else F.lit(True))
            known[m] = runs.sparkSession.sparkContext.broadcast(Bitmap.of(mine.select(F.xxhash64(*rest[:m]).alias("h")), "h"))
        asked = _summed(runs, tuple(lengths), _asked(known)).select(*(F.col(w).alias(r) for w, r in zip(_W, rest, strict=False)), F.col("n").alias("more"))
        each = each.join(written(asked.join(missing, rest, "left_semi"), "asked"), rest, "left").withColumn("r", F.coalesce("r", "more")).withColumn("score", F.expr(_SCORE))
    best = each.groupBy(*_GROUP, "bound").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select(*_GROUP, "bound", "best.*")
    return best.where(beats("score")).drop("bound")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, least_step: int = LEAST_STEP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of `least` places or more."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    salt, words, totals = _vocabulary(texts, least)
    words = written(_steps(words, least_step).join(totals, "lang"), "steps")
    frequent = docs.sparkSession.sparkContext.broadcast(Bitmap.of(words, "h"))
    runs = written(texts.mapInArrow(_encoded_batches(salt, frequent), "words binary, codes binary"), "runs")
    zero = F.lit(0).cast("long")
    counts = words.select(F.col("h").alias("w1"), *(zero.alias(w) for w in _W[1:]), "n")
    phrases, left, settled = None, words.select("lang").distinct(), []
    same = lambda side: (F.col(f"{side}_min") == F.col(f"{side}_max")) & (F.col(f"{side}_min") != 0)
    for step in range(len(SHARES)):
        now = words.join(left, "lang", "left_semi").where(F.col("step") == step)
        if not now.limit(1).count():
            continue
        grown = written(_grown(runs, now, least), "grown")
        counts = counts.union(grown.select(*_W, "n"))
        kept = grown.where(~same("before") & ~same("after") | (F.col(f"w{LONGEST}") != 0)).select("lang", "total", *_W, F.col("n").alias("a"))
        phrases = kept if phrases is None else phrases.union(kept)
        later = words.where(F.col("step") > step).groupBy("lang").agg(F.min("n").alias("next"))
        bounds = words.join(left, "lang", "left_semi").select("lang", "total").distinct().join(later, "lang", "left").select("lang", F.coalesce(F.expr("1000 * cast(total AS decimal(38,0)) div cast(next AS decimal(38,0))"), F.lit(-1)).alias("bound"))
        bounds = written(bounds, "bounds")
        good = written(_best_cuts(runs, phrases.join(left, "lang", "left_semi"), counts, bounds), "good")
        many = good.groupBy("lang").agg(F.count(F.lit(1)).alias("many"))
        ready = written(bounds.join(many, "lang", "left").where((F.col("bound") < 0) | (F.coalesce("many", F.lit(0)) >= top)).select("lang"), "ready")
        settled.append(good.join(ready, "lang", "left_semi"))
        left = written(left.join(ready, "lang", "left_anti"), "left")
    if not settled:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.union(more)
    # Ties with the last place stay until the phrases are spelt out; Spark limits each task's rows by rank before it shuffles them.
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    rows = rows.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top)
    for i, w in enumerate(_W):
        spelt = words.select(F.col("h").alias(w), F.col("word").alias(f"s{i}"))
        rows = rows.join(spelt, w, "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *(f"s{i}" for i in range(LONGEST))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i+m-1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS n FROM g GROUP BY lang, m, phrase),
t AS (SELECT lang, sum(n)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, n AS a FROM f WHERE m >= 2 AND n >= 100),
k AS (SELECT lang, phrase, a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS ws FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.n AS l, y.n AS r, t.n, (1000::HUGEINT * k.a * t.n) // (x.n * y.n) AS score FROM k JOIN t USING (lang)
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k.k+1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = b.lang AND y.m > len(string_split(b.phrase, ' ')) AND 100 * y.a >= 100 * b.a AND contains(' ' || y.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o QUALIFY rank <= 2000
"""


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
