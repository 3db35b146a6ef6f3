"""The evaluation job: questions, hybrid retrieval, gold by containment, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, retrieval

#: Words of the probe that passages and documents meet on.
PROBE = 5


def questions(benchmark: DataFrame) -> DataFrame:
    """Every passage, all its words, as a question."""
    return benchmark.select(F.col("item_id").alias("q_id"), F.array_join(tx.tokens(F.col("text"), False), " ").alias("text"))


def keyword_hits(docs: DataFrame, benchmark: DataFrame, k: int, **settings) -> DataFrame:
    return retrieval.bm25(docs, questions(benchmark), k, **settings)


def gold(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(q_id, doc_id) where a document holds the passage word for word.

    Documents and passages meet on a hash of consecutive whole words: a passage's words from the second on, PROBE at most
    and none of its last, against every document's runs of that length, so no document is compared with a passage it
    shares nothing with. Only ids and hashes are shuffled; texts join the few pairs that met. A passage of two words or
    fewer has no whole word to probe with and is looked for in every document.
    """
    words = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    passages = benchmark.select(F.col("item_id").alias("q_id"), F.col("text").alias("passage"))
    asked = passages.withColumn("w", words(F.col("passage"))).withColumn("n", F.least(F.lit(PROBE), F.size("w") - 2)).where("passage IS NOT NULL")
    probes = asked.where("n > 0").select("q_id", "n", F.xxhash64("n", F.array_join(F.expr("slice(w, 2, n)"), " ")).alias("h"))
    lengths = [r.n for r in probes.select("n").distinct().collect()]  # at most PROBE numbers
    # one number a run, its length in it: equal numbers are found by hashing, in time that grows with the text
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice("w", i, n), " ")))
    found = passages.where("passage IS NOT NULL").join(docs.select("doc_id", "text"), F.lit(False)).select("q_id", "doc_id")
    if lengths:
        at = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", F.explode(F.array_distinct(F.concat(*map(runs, lengths)))).alias("h"))
        met = at.join(probes, "h").select("q_id", "doc_id").distinct()
        found = met.join(docs.select("doc_id", "text"), "doc_id").join(passages, "q_id").where(F.contains("text", "passage")).select("q_id", "doc_id")
    short = asked.where("n <= 0").select("q_id", "passage")
    if short.limit(1).count():
        found = found.union(short.join(docs.select("doc_id", "text"), F.contains("text", "passage")).select("q_id", "doc_id"))
    return found.distinct()


def run(docs: DataFrame, benchmark: DataFrame, k: int = 5) -> DataFrame:
    """hit, recall, mrr and ndcg at k for every question that has gold documents; each gold document is a one-page range."""
    hits = keyword_hits(docs, benchmark, k).select("q_id", "rank", F.col("doc_id").alias("page_start"), F.col("doc_id").alias("page_end"))
    ranges = gold(docs, benchmark).select("q_id", F.col("doc_id").alias("range"), F.col("doc_id").alias("start"), F.col("doc_id").alias("end"))
    return evaluation.hit_metrics(hits, ranges, k)
