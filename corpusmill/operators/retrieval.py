"""Keyword and vector search for batches of questions, fusion of ranked lists, reranking and context selection.

Every operator takes all questions at once, keyed by a question id. Ties are ordered by document id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import stored, stored_blocks
from . import blocks

K1, B, RRF_K = 1.5, 0.75, 60


def postings(docs: DataFrame, keys: list[str], text: str = "text", stem: bool = False) -> DataFrame:
    """(keys, term, tf). Stems are found once for each distinct word, not for each occurrence."""
    words = docs.select(*keys, F.explode(tx.tokens(F.col(text))).alias("term"))
    counted = words.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    if not stem:
        return counted
    stems = counted.select("term").distinct().withColumn("stem", tx.stemmed("term"))
    return counted.join(stems, "term").groupBy(*keys, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def word_forms(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(word, term): the distinct words of the texts whose stem is one of wanted(term), as a written table. Only distinct words are
    shuffled and stemmed, each once, so postings needn't meet their stems."""
    # written first: else Spark moves the stemmer below the distinct, and so to every occurrence
    words = stored(docs.select(F.explode(F.array_distinct(tx.tokens(F.col(text)))).alias("word")).distinct(), "vocabulary")
    stems = words.select("word", tx.stemmed("word").alias("term"))
    known = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
    return stored(stems.join(known, "term", "left_semi").select("word", "term"), "forms")


def lengths(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, F.size(tx.tokens(F.col(text))).cast("long").alias("len"))


#: Stands in every document, so that one aggregate gives both the documents of each term and those of the scope.
_EVERY = "\0"
#: The questions' words are broadcast up to this many; beyond it the join shuffles.
BROADCAST_TERMS = 200_000
#: Scores of questions and documents that a task has at once; documents in a block of postings, and occurrences that are held until one is cut.
CELLS, POSTING_DOCS, OCCURRENCES = 1 << 16, 4_096, 1_000_000


def term_statistics(docs: DataFrame, wanted: DataFrame, by: list[str], text: str = "text", stem: bool = False) -> DataFrame:
    """(by, term, df, n, avg_len) for the terms of wanted(term): documents that have each, all documents and their mean
    length, within each scope. One pass over the texts; what it leaves is one row for each wanted term and scope."""
    sized = docs.select(*by, tx.tokens(F.col(text)).alias("ts"))
    seen = sized.select(*by, F.size("ts").cast("long").alias("len"), F.explode(F.array_distinct(F.concat("ts", F.array(F.lit(_EVERY))))).alias("term"))
    if stem:
        raise ValueError("stems are counted from their postings")
    kept = seen.join(F.broadcast(wanted.union(wanted.sparkSession.createDataFrame([(_EVERY,)], "term string"))), "term", "left_semi")  # the words of a stated set of questions
    counts = kept.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"), F.avg(F.when(F.col("term") == _EVERY, F.col("len"))).alias("avg"))
    scope = Window.partitionBy(*by)  # one row for each wanted term
    every = F.col("term") == _EVERY
    filled = counts.withColumn("n", F.max(F.when(every, F.col("df"))).over(scope)).withColumn("avg_len", F.max("avg").over(scope))
    return filled.where(~every).drop("avg")


def bm25(docs: DataFrame, questions: DataFrame, k: int, scope: str | None = None, stem: bool = False) -> DataFrame:
    """Top k documents (q_id, doc_id, score, rank) for questions(q_id, text).

    Texts are read once (for stems, once more for their distinct words): the postings of the questions' terms are written as a table, and the
    statistics are taken from it; only terms that a question has survive the join below the aggregation. N, document frequencies and the mean
    length are those of the scope (a column of docs, such as an owner), if one is given: then each scope ranks its own. Stems without a
    scope are scored in blocks (`ranked_blocks`): so many words share a stem that a row for each term, question and document would be most of the work.
    """
    by = [scope] if scope else []
    asked = stored(postings(questions, ["q_id"], stem=stem).select("q_id", "term"), "asked")
    keys, wanted = ["doc_id", *by, "len"], asked.select("term").distinct()  # the length rides along, so postings never meet their documents again
    known = F.broadcast if wanted.count() <= BROADCAST_TERMS else lambda df: df
    sized = docs.select("doc_id", *by, tx.tokens(F.col("text")).alias("ts")).withColumn("len", F.size("ts").cast("long"))
    # every document has one row more, whose term no text can have: the documents and their lengths
    each = sized.select(*keys, F.explode(F.concat("ts", F.array(F.lit(_EVERY)))).alias("term"))
    every = wanted.union(wanted.sparkSession.createDataFrame([(_EVERY,)], "term string"))
    if stem:
        forms = word_forms(docs, wanted)
        bound = F.broadcast if forms.count() <= BROADCAST_TERMS else lambda df: df
        if not by:
            return ranked_blocks(each, forms, bound, asked, docs.count(), k)
        read = each.withColumnRenamed("term", "word").join(bound(forms.union(every.where(F.col("term") == _EVERY).select("term", "term"))), "word")
    else:
        read = each.join(known(every), "term", "left_semi")
    table = stored(read.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    found = table.where(F.col("term") != _EVERY)
    stats = table.where(F.col("term") == _EVERY).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    df = found.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    terms = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row without a scope
    rows = asked.join(terms, "term").join(found, ["term", *by])
    part = _idf() * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.col("avg_len")))
    scores = rows.groupBy("q_id", *by, "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return top(scores, k, ["q_id", *by])


def _idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))


def _postings_block(ids: np.ndarray, words: np.ndarray, lens: np.ndarray) -> pa.RecordBatch:
    """Occurrences sorted by document -> one row: documents, their lengths, their words, and for each word where it stands and how often."""
    fresh = blocks.edges(ids)
    docs, lens, at = ids[fresh], lens[fresh], np.cumsum(fresh) - 1
    at, words = at[words >= 0], words[words >= 0]
    order = np.argsort(words, kind="stable")
    words, at = words[order], at[order]
    one = np.flatnonzero(blocks.edges(words, at))
    tf = np.diff(np.append(one, len(words)))
    words, at = words[one], at[one]
    begins = np.flatnonzero(blocks.edges(words))
    return blocks.row(docs, lens, words[begins], np.append(begins, len(words)).astype(np.int32), at.astype(np.uint16), tf.astype(np.int32), names="docs lens words begins places tfs")


class _Questions(blocks.Best):
    """A block of questions with their terms, and the first k documents of each so far."""

    def __init__(self, packed: list[bytes], k: int) -> None:
        ids, self.word, self.idf, mean = (np.frombuffer(x, t) for x, t in zip(packed, (np.int64, np.int64, np.float64, np.float64), strict=True))
        fresh = blocks.edges(ids)
        super().__init__(ids[fresh], k)
        self.at, self.mean = np.cumsum(fresh) - 1, mean[0]

    def meet(self, docs: np.ndarray, lens: np.ndarray, words: np.ndarray, begins: np.ndarray, places: np.ndarray, tfs: np.ndarray) -> None:
        """Scores a block of documents: up to CELLS questions and documents at once."""
        if not len(words):
            return
        i = np.minimum(np.searchsorted(words, self.word), len(words) - 1)
        has = words[i] == self.word
        at, i, idf = self.at[has], i[has], self.idf[has]
        norm = tfs + K1 * ((1 - B) + B * lens[places] / self.mean)
        k, step = self.score.shape[1], max(1, CELLS // len(docs))
        for q in range(0, len(self.ids), step):
            a, b = np.searchsorted(at, (q, q + step))
            held, size = blocks.spans(begins, i[a:b])
            part = np.repeat(idf[a:b], size) * tfs[held] * (K1 + 1) / norm[held]
            cell = np.repeat(at[a:b] - q, size) * len(docs) + places[held]
            rows = min(step, len(self.ids) - q)
            score = np.round(np.bincount(cell, part, rows * len(docs)).reshape(rows, -1), 6)
            least, last = self.score[q : q + rows, -1:], self.doc[q : q + rows, -1:]
            enters = (score > 0) & ((score > least) | ((score == least) & (docs < last)))
            if len(docs) > k:
                enters &= score >= np.partition(score, len(docs) - k, axis=1)[:, len(docs) - k, None]
            r, d = np.nonzero(enters)
            if len(r):
                self.merge(r + q, docs[d], score[r, d])


def ranked_blocks(each: DataFrame, forms: DataFrame, bound: Callable[[DataFrame], DataFrame], asked: DataFrame, count: int, k: int, per_block: tuple[int, int] = (POSTING_DOCS, blocks.QUESTIONS)) -> DataFrame:
    """each(doc_id, len, term): every occurrence, and the row that stands in every document; forms(word, term): what counts as a term;
    asked(q_id, term) -> the top k (q_id, doc_id, score, rank).

    Documents are packed in blocks by term, with frequencies; document frequencies are counted from the blocks. Where a block of documents
    meets one of questions, their scores are summed in place and each question keeps its first k, so a row for a question and a document is
    neither written nor shuffled. Documents and questions without an id take no part."""
    spark = asked.sparkSession
    numbers = stored(asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "terms")
    read = forms.join(numbers, "term").select("word", "number").union(spark.createDataFrame([(_EVERY, -1)], "word string, number long"))
    rows = each.where("doc_id IS NOT NULL").withColumnRenamed("term", "word").join(bound(read), "word").select(F.col("doc_id").cast("long").alias("id"), "number", "len")
    pack = lambda df, n, size: df.repartition(max(1, -(-n // size)), "id").sortWithinPartitions("id")
    most = OCCURRENCES

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in blocks.cut(batches, per_block[0], most):
            yield _postings_block(*columns)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lens, words, begins in zip(*(b.column(c) for c in ("lens", "words", "begins")), strict=True):
                lens, words = np.frombuffer(lens.as_buffer(), np.int64), np.frombuffer(words.as_buffer(), np.int64)
                df = np.diff(np.frombuffer(begins.as_buffer(), np.int32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(words, -1)), pa.array(np.append(df, len(lens))), pa.array(np.append(np.zeros(len(words), np.int64), lens.sum()))], names=["number", "df", "len"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in blocks.cut(batches, per_block[1], most):
            yield blocks.row(*columns, names="q_ids q_numbers q_idfs q_means")

    left = stored_blocks(pack(rows, count, per_block[0]).mapInArrow(documents, ", ".join(f"{c} binary" for c in "docs lens words begins places tfs".split())), "postings")
    sums = left.select("lens", "words", "begins").mapInArrow(counted, "number long, df long, len long").groupBy("number").agg(F.sum("df").alias("df"), F.sum("len").alias("len"))
    sums = stored_blocks(sums, "frequencies")
    stats = sums.where("number = -1").select(F.col("df").alias("n"), (F.col("len") / F.col("df")).alias("avg_len"))
    weights = sums.where("number >= 0").crossJoin(F.broadcast(stats)).select("number", _idf().alias("idf"), "avg_len")  # one row
    terms = stored(asked.where("q_id IS NOT NULL").join(numbers, "term").join(weights, "number").select(F.col("q_id").cast("long").alias("id"), "number", "idf", "avg_len"), "weights")
    right = stored_blocks(pack(terms, terms.select("id").distinct().count(), per_block[1]).mapInArrow(asking, ", ".join(f"{c} binary" for c in "q_ids q_numbers q_idfs q_means".split())), "questions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, _Questions] = {}  # the questions of this task
        kinds = (np.int64, np.int64, np.int64, np.int32, np.uint16, np.int32)
        for b in batches:
            for i in range(b.num_rows):
                d, q = [b.column(c)[i].as_buffer() for c in range(6)], [b.column(c)[i].as_buffer() for c in range(6, 10)]
                key = q[0].slice(0, 8).to_pybytes()  # a question is in one block only
                if key not in met:
                    met[key] = _Questions([x.to_pybytes() for x in q], k)
                met[key].meet(*(np.frombuffer(x, t) for x, t in zip(d, kinds, strict=True)))
        for x in met.values():
            yield x.rows()

    return top(stored_blocks(left.coalesce(blocks.PARTS).crossJoin(right).mapInArrow(run, "q_id long, doc_id long, score double"), "hits"), k, ["q_id"])


def top(scores: DataFrame, k: int, by: list[str], item: str = "doc_id") -> DataFrame:
    """The k best of each group with their rank; partial top-k happens before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(vectors: DataFrame, key: str, size: int, prefix: str, scope: str | None = None) -> DataFrame:
    """Rows of up to `size` vectors: packed ids, a packed float64 matrix, and packed scopes (0 without one)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["embedding"].notna()]
            for at in range(0, len(f), size):
                part = f.iloc[at : at + size]
                packed = (part[key].to_numpy(np.int64), np.stack(part["embedding"]).astype(np.float64), part["scope"].to_numpy(np.int64))
                yield pd.DataFrame({prefix + c: [a.tobytes()] for c, a in zip("smg", packed, strict=True)})

    group = F.col(scope).cast("long") if scope else F.lit(0).cast("long")
    return vectors.select(key, "embedding", group.alias("scope")).where("scope IS NOT NULL").mapInPandas(run, ", ".join(f"{prefix}{c} binary" for c in "smg"))


def dense(vectors: DataFrame, questions: DataFrame, k: int, key: str = "vec_id", block: int = 1024, scope: str | None = None) -> DataFrame:
    """Exact top k by dot product: blocks of questions meet blocks of vectors as matrices, each pair keeps its own top k,
    and those are merged. A stated set of questions against all rows. With an integer column as scope (a document, an
    owner), each of its values ranks its own; rows without one are left out."""
    left, right = _blocks(questions, key, block, "q"), _blocks(vectors, key, block, "v", scope)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                q, v = np.frombuffer(r.qs, np.int64), np.frombuffer(r.vs, np.int64)
                score = np.round(np.frombuffer(r.qm).reshape(len(q), -1) @ np.frombuffer(r.vm).reshape(len(v), -1).T, 6)
                groups = np.frombuffer(r.vg, np.int64)
                for g in np.unique(groups):
                    own, part = v[groups == g], score[:, groups == g]
                    order = np.lexsort((np.broadcast_to(own, part.shape), -part), axis=1)[:, :k]
                    n = order.shape[1]
                    yield pd.DataFrame({"q_id": np.repeat(q, n), key: own[order].ravel(), "score": np.take_along_axis(part, order, 1).ravel(), "scope": g})

    pairs = right.crossJoin(left).mapInPandas(run, f"q_id long, {key} long, score double, scope long")
    return top(pairs.withColumnRenamed("scope", scope), k, ["q_id", scope], key) if scope else top(pairs.drop("scope"), k, ["q_id"], key)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (q_id, doc_id, rank); ties keep the order of first appearance."""
    rows = None
    for i, one in enumerate(lists):
        part = one.select("q_id", "doc_id", "rank", F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("q_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "first", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).select("q_id", "doc_id", "score", "rank")


def weighted(lists: list[DataFrame], weights: tuple[float, ...]) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each question and list; a list of equal scores counts as 1."""
    if len(lists) != len(weights):
        raise ValueError("one weight for each list")
    rows, by = None, Window.partitionBy("q_id")
    for i, (one, w) in enumerate(zip(lists, weights, strict=True)):
        lo, hi = F.min("score").over(by), F.max("score").over(by)
        part = one.select("q_id", "doc_id", "rank", F.lit(i).alias("list"), (F.lit(w) * F.when(lo == hi, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("q_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "first", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).select("q_id", "doc_id", "score", "rank")


def overlap_rerank(hits: DataFrame, questions: DataFrame, docs: DataFrame, k: int | None) -> DataFrame:
    """Ranks hits anew by how many distinct words they share with the question; ties keep the earlier rank. k None keeps all,
    with the earlier rank as `before`."""
    words = lambda c: F.split(F.trim(F.lower(c)), r"[\x20\x09-\x0D]+")
    rows = hits.select("q_id", "doc_id", F.col("rank").alias("before")).join(questions.select("q_id", F.col("text").alias("q")), "q_id").join(docs.select("doc_id", "text"), "doc_id")
    scored = rows.select("q_id", "doc_id", "before", F.size(F.array_intersect(words(F.col("q")), words(F.col("text")))).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "before")))
    return ranked.select("q_id", "doc_id", "before", "score", "rank") if k is None else ranked.where(F.col("rank") <= k).select("q_id", "doc_id", "score", "rank")


def cap_per_source(hits: DataFrame, cap: int) -> DataFrame:
    """At most `cap` hits of one source for each question, in rank order."""
    seen = Window.partitionBy("q_id", "source").orderBy("rank")
    return hits.withColumn("nth", F.row_number().over(seen)).where(F.col("nth") <= cap).drop("nth")


def with_parents(hits: DataFrame, children: DataFrame) -> DataFrame:
    """hits(q_id, rank, chunk_id) with the chunk's parent in its place, where children(chunk_id, parent_id) names one; the
    best hit of a parent speaks for it."""
    found = hits.select("q_id", "rank", "chunk_id").join(children.select("chunk_id", "parent_id"), "chunk_id", "left")
    return found.groupBy("q_id", F.coalesce("parent_id", "chunk_id").alias("chunk_id")).agg(F.min("rank").alias("rank"))


#: Why a passage is passed over, in the order of the tests.
PASSED = ("repeated", "flagged", "overlap", "copy", "source cap", "word budget", "enough")
_CHOSEN = "struct<chunk_id:bigint,source:string,doc:bigint,start:bigint,end:bigint,copy:string>"


def chosen_context(hits: DataFrame, chunks: DataFrame, top_k: int = 5, max_words: int = 1500, overlap: float = 0.5, per_source: int = 2) -> DataFrame:
    """hits(q_id, rank, chunk_id), chunks(chunk_id, source, doc, start, end, text) -> (q_id, chunk_id, rank, rules, position,
    passed): every hit with its place in the prompt, or why it has none (PASSED).

    In rank order, a passage is passed over if it is chosen already, matches a scan rule (`rules` names them), overlaps a
    chosen passage of its document by `overlap` of the shorter one, copies a chosen text, exceeds its source's cap (0: none)
    or the word budget (the first passage always fits), or once top_k are chosen. Each chunk hit is scanned once, whatever
    the number of questions that hit it; the ordered choice is a fold over a question's hits.
    """
    wanted = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    ready = wanted.select(
        "chunk_id", "source", "doc", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), tx.scan(F.col("text")).alias("rules"), tx.word_count(F.col("text")).alias("words"),
        F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))), 256).alias("copy"),
    )
    rows = hits.select("q_id", "rank", "chunk_id").join(ready, "chunk_id")
    ordered = rows.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "source", "doc", "start", "end", "rules", "words", "copy"))).alias("hits"))
    shared = "greatest(0L, least(x.end, c.end) - greatest(x.start, c.start)) / greatest(1L, least(x.end - x.start, c.end - c.start))"
    test = f"""CASE WHEN exists(a.kept, c -> c.chunk_id = x.chunk_id) THEN 1 WHEN size(x.rules) > 0 THEN 2 WHEN exists(a.kept, c -> c.doc <=> x.doc AND {shared} >= {overlap}D) THEN 3
        WHEN exists(a.kept, c -> c.copy = x.copy) THEN 4 WHEN {per_source} > 0 AND size(filter(a.kept, c -> c.source = x.source)) >= {per_source} THEN 5
        WHEN size(a.kept) > 0 AND a.words + x.words > {max_words} THEN 6 WHEN size(a.kept) >= {top_k} THEN 7 ELSE 0 END"""
    kept = "array(named_struct('chunk_id', x.chunk_id, 'source', x.source, 'doc', x.doc, 'start', x.start, 'end', x.end, 'copy', x.copy))"
    step = f"""element_at(transform(array({test}), w -> named_struct('kept', if(w = 0, concat(a.kept, {kept}), a.kept), 'words', a.words + if(w = 0, x.words, 0), 'why', concat(a.why, array(w)))), 1)"""
    start = f"named_struct('kept', cast(array() AS array<{_CHOSEN}>), 'words', 0, 'why', cast(array() AS array<int>))"
    done = ordered.withColumn("done", F.expr(f"aggregate(hits, {start}, (a, x) -> {step})"))
    each = done.select("q_id", F.posexplode("hits").alias("i", "x"), F.col("done.why").alias("why"))
    nth = F.expr("if(why[i] = 0, size(filter(slice(why, 1, i + 1), w -> w = 0)), NULL)")
    return each.select("q_id", "x.chunk_id", "x.rank", "x.rules", nth.alias("position"), F.expr(f"if(why[i] > 0, array({', '.join(repr(w) for w in PASSED)})[why[i] - 1], NULL)").alias("passed"))


def select_context(hits: DataFrame, chunks: DataFrame, **limits) -> DataFrame:
    """The passages for the prompt: (q_id, chunk_id, position). See `chosen_context`."""
    return chosen_context(hits, chunks, **limits).where("position IS NOT NULL").select("q_id", "chunk_id", "position")


def hashed_counts(docs: DataFrame, dimensions: int = 256) -> DataFrame:
    """(doc_id, bucket, n): words of a-z and 0-9 counted by crc32, as the hashing embedder does before it scales them."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    return words.groupBy("doc_id", (F.crc32(F.encode("w", "utf-8")) % dimensions).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def find_terms(docs: DataFrame, terms: list[str], most: int, around: int = 30) -> DataFrame:
    """(term, doc_id, place, snippet, nth): the first `most` documents, by id, that hold a term, case aside.

    `terms` is a stated, short list; each text is looked through once, and only `most` rows a term leave a task.
    Places count from 1 in the lower-cased text. Null texts hold nothing; empty terms are left out.
    """
    wanted = F.array(*(F.lit(x.lower()) for x in dict.fromkeys(terms) if x)).cast("array<string>")
    low = docs.select("doc_id", F.lower("text").alias("__low"), wanted.alias("__terms"))
    hits = low.select("doc_id", "__low", F.explode(F.filter("__terms", lambda x: F.col("__low").contains(x))).alias("term"))
    place = F.expr("position(term, __low)")
    snippet = F.expr(f"substring(__low, greatest(1, position(term, __low) - {around}), length(term) + {2 * around})")
    rows = hits.select("term", "doc_id", place.alias("place"), snippet.alias("snippet"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).where(F.col("nth") <= most)
