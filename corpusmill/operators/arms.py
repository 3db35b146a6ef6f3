"""An experiment over conversations, item by item and arm by arm, as one plan: history, gate, rewriter's reply, search, score, summary.

Every item has a forced history (questions with reference answers, not what a model said), so the arms differ in the last question only: `off`
asks the message as it is, `on` what the rewriter made of it (nothing if it asked back), `oracle` the standalone question. Replies of the
rewriter come as a table, since no model runs here; items without one fall back to the message. All arms' questions are searched at
once, by the search that is handed in.

Defined results: null texts are empty; an item without history has an empty one; an item that expects a clarification takes no part in the
means; an arm without a question scores 0; no items give one row of zeros.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import stored

ARMS = ("off", "on", "oracle")


def forced(items: DataFrame, turns: int = 6) -> DataFrame:
    """items(item, expect, message, standalone, history) with the last `turns` of the history, its words, and whether the gate sends the
    message to the rewriter."""
    history = F.coalesce("history", F.array().cast("array<struct<question:string,answer:string>>"))
    kept = F.slice(history, F.greatest(F.lit(1), F.size(history) - turns + 1), F.lit(turns))
    words = F.aggregate(kept, F.lit(0).cast("long"), lambda s, h: s + tx.word_count(F.concat_ws(" ", h["question"], h["answer"])))
    message = F.coalesce("message", F.lit(""))
    return items.withColumns({"history": kept, "history_words": words, "message": message, "standalone": F.coalesce("standalone", F.lit("")), "fires": tx.needs_rewrite(message, F.size(kept))})


def asked(staged: DataFrame, replies: DataFrame) -> DataFrame:
    """`forced` items and replies(item, status, question, named) -> a row an item and arm: (item, expect, arm, question, fires, status, named)."""
    rows = staged.join(replies.select("item", "status", F.col("question").alias("__made"), "named"), "item", "left")
    status = F.when(~F.col("fires"), "standalone").otherwise(F.coalesce("status", F.lit("fallback")))
    rows = rows.withColumn("status", status)
    on = F.when(F.col("status") == "clarify", F.lit(None)).when(F.col("status") == "rewrite", F.coalesce("__made", "message")).otherwise(F.col("message"))
    arm = lambda name, q: F.struct(F.lit(name).alias("arm"), q.alias("question"))
    each = F.explode(F.array(arm("off", F.col("message")), arm("on", on), arm("oracle", F.col("standalone")))).alias("a")
    return rows.select("item", "expect", "fires", "status", "named", "history_words", each).select("item", "expect", "fires", "status", "named", "history_words", "a.*")


def scored(arms: DataFrame, gold: DataFrame, search: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
    """arms with `hit`: 1 if a document of gold(item, doc_id) is among the first k that search(questions(q_id, text)) finds.

    Equal questions are searched once."""
    texts = arms.where("question IS NOT NULL").select(F.col("question").alias("text")).distinct().withColumn("q_id", F.xxhash64("text"))
    hits = search(texts).where(F.col("rank") <= k).select("q_id", "doc_id")
    found = arms.where("question IS NOT NULL").select("item", "arm", F.xxhash64("question").alias("q_id"))
    right = found.join(hits, "q_id").join(gold, ["item", "doc_id"], "left_semi").select("item", "arm").distinct().withColumn("hit", F.lit(1))
    return arms.join(right, ["item", "arm"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def summary(rows: DataFrame) -> DataFrame:
    """One row: items, the arms' means, wins, ties and losses of `on` against `off`, the share of the oracle's gap that it closes, gate
    calls, fallbacks, clarifications asked where one was expected and where not."""
    one = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("hit"))).alias(arm)
    items = rows.groupBy("item").agg(*map(one, ARMS), F.first("expect").alias("expect"), F.first("fires").alias("fires"), F.first("status").alias("status"), F.coalesce(F.first("named"), F.lit(False)).alias("named"))
    answer = F.coalesce(F.col("expect") == "answer", F.lit(False))
    count = lambda test, name: F.count_if(test).alias(name)
    sums = items.agg(
        F.count(F.lit(1)).alias("items"), count(answer, "n"), *(F.coalesce(F.sum(F.when(answer, F.col(a))), F.lit(0)).alias(a) for a in ARMS), count(answer & (F.col("on") > F.col("off")), "wins"), count(answer & (F.col("on") < F.col("off")), "losses"),
        count(F.col("fires"), "gate_calls"), count(F.col("fires") & (F.col("status") == "fallback"), "fallbacks"), count(answer & (F.col("status") == "clarify"), "false_clarify"),
        count(~answer, "clarify_n"), count(~answer & (F.col("status") == "clarify"), "clarify_asked"), count(~answer & (F.col("status") == "clarify") & F.col("named"), "clarify_named"),
    )
    mean = lambda a: F.round(F.col(a) / F.greatest("n", F.lit(1)), 3).alias(f"hit_{a}")
    gap: Column = F.when(F.col("oracle") > F.col("off"), F.round((F.col("on") - F.col("off")) / (F.col("oracle") - F.col("off")), 3))
    return sums.select("items", "n", *map(mean, ARMS), "wins", (F.col("n") - F.col("wins") - F.col("losses")).alias("ties"), "losses", gap.alias("gap_closed"), "gate_calls", "fallbacks", "false_clarify", "clarify_n", "clarify_asked", "clarify_named")


def run(items: DataFrame, replies: DataFrame, gold: DataFrame, search: Callable[[DataFrame], DataFrame], k: int = 5, turns: int = 6) -> DataFrame:
    """The summary of the whole experiment."""
    rows = stored(asked(forced(items, turns), replies), "arms")  # read for the questions, their hits and the summary
    return summary(scored(rows, gold, search, k))
