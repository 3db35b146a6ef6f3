"""Tables of experiments: arms, categories, status counts, choices, traces and their audit, registries and review sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def arm_means(scores: DataFrame, by: list[str]) -> DataFrame:
    """scores(by, arm, hit, mrr, recall) -> items and means (3 decimals) of each arm; null scores are left out."""
    mean = lambda c: F.round(F.avg(c), 3).alias(c)
    return scores.groupBy(*by, "arm").agg(F.count("hit").alias("n"), *map(mean, ("hit", "mrr", "recall")))


def category_table(items: DataFrame, arms: list[str]) -> DataFrame:
    """items(category, fired, asked, arm columns with 0 or 1) -> a row for each category: items, how often the gate fired and asked
    back, the mean of every arm, and wins, losses and ties of the second arm against the first."""
    first, second = F.col(arms[0]), F.col(arms[1])
    return items.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("fired").alias("gate_fired"), F.count_if("asked").alias("asked"), *(F.round(F.avg(a), 3).alias(f"hit_{a}") for a in arms),
        F.count_if(second > first).alias("wins"), F.count_if(second < first).alias("losses"), F.count_if(second == first).alias("ties"),
    )


def status_counts(rows: DataFrame) -> DataFrame:
    """rows(status, reason) -> (kind, value, n): how often each status, and each reason among fallbacks."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    each = rows.select(F.explode(F.array(pair("status", F.col("status")), pair("reason", F.when(F.col("status") == "fallback", F.col("reason"))))).alias("x")).select("x.*")
    return each.where("value IS NOT NULL").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def chosen_rewriter(rates: DataFrame, band: float) -> DataFrame:
    """rates(spec, place, hit, p50) of two rewriters (place 1 and 2) -> (chosen, reason): the one whose hit rate is higher by more
    than `band` points, else the faster one; a missing latency is slowest, the first wins a tie."""
    slow = F.coalesce("p50", F.lit(float("inf")))
    one = lambda place, c: F.max(F.when(F.col("place") == place, c))
    both = rates.agg(*(one(k, c).alias(f"{n}{k}") for k in (1, 2) for n, c in (("spec", F.col("spec")), ("hit", F.col("hit")), ("p", slow))))
    far = 100.0 * (F.col("hit2") - F.col("hit1"))
    better = "on hit@5 higher by more than the band"
    chosen = F.when(F.col("spec2").isNull(), F.col("spec1")).when(far > band, F.col("spec2")).when(-far > band, F.col("spec1")).when(F.col("p2") < F.col("p1"), F.col("spec2")).otherwise(F.col("spec1"))
    reason = F.when(F.col("spec2").isNull(), F.concat("spec1", F.lit(" by default, not compared"))).when(F.abs(far) > band, better).otherwise("inside the band; lower p50 latency")
    return both.select(chosen.alias("chosen"), reason.alias("reason"))


def regression(off: DataFrame, on: DataFrame) -> DataFrame:
    """off and on (q_id, rank, chunk_id): contexts of the same questions without and with rewriting -> one row: questions, how many
    have the same chunks in the same order, and how many changed. A context holds few chunks."""
    ids = lambda df, name: df.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias(name))
    rows = ids(off, "a").join(ids(on, "b"), "q_id", "left")
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("identical"), F.count_if(~same).alias("changed"))


def answer_arms(rows: DataFrame, band: float) -> DataFrame:
    """rows(arm, correct) with arms on and on_original -> (arm, correct, judged, rate, keep): `keep` is the rewritten question
    unless the original message is better by more than the band."""
    sums = rows.groupBy("arm").agg(F.count_if("correct").alias("correct"), F.count("correct").alias("judged")).withColumn("rate", F.round(F.expr("correct / nullif(judged, 0)"), 3))
    rate = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("rate"))).over(Window.partitionBy(F.lit(1)))  # noqa: E731  one row an arm
    return sums.withColumn("keep", F.when(100.0 * (rate("on_original") - rate("on")) > band, "original message").otherwise("rewritten question"))


def retrieval_table(ranks: DataFrame, by: list[str], candidates: int = 30) -> DataFrame:
    """ranks(by, q_id, best, ms, failure): a question's best rank, null if not found -> hit@1, hit@5, MRR, candidates, ms a question
    and failures of each configuration."""
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("best") <= k).cast("int"), F.lit(0))), 3)
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), hit(1).alias("hit_1"), hit(5).alias("hit_5"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0))), 3).alias("mrr"), hit(candidates).alias("candidates"),
        F.round(F.avg("ms"), 1).alias("ms"), F.count_if(F.col("failure") != "retrieval_ok").alias("failures"),
    )


def fact_counts(rows: DataFrame) -> DataFrame:
    """rows(id, text, facts: array) -> (id, stated, total): facts that stand in the text, case aside."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return rows.select("id", F.size(F.filter("facts", lambda x: low.contains(F.lower(x)))).alias("stated"), F.size("facts").alias("total"))


def check_set(items: DataFrame) -> DataFrame:
    """items(eligible, off, oracle) -> one row: eligible items, those the raw message misses, those the oracle misses, and controls."""
    return items.agg(F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & (F.col("off") == 0)).alias("discriminating"), F.count_if(F.col("oracle") == 0).alias("oracle_misses"), F.count_if(F.col("off") == F.col("oracle")).alias("controls"))


def answer_report(answers: DataFrame) -> DataFrame:
    """answers(kind, outcome, correct, leaked, blocked, valid) -> for each kind: answers, unjudged, the rate of correct ones (null
    where over a quarter is unjudged), leaks, blocked answers, invalid citations, and its outcomes with their counts."""
    unjudged = F.count_if(F.col("outcome") == "unjudged")
    sums = answers.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), unjudged.alias("unjudged"), F.when(unjudged / F.count(F.lit(1)) <= 0.25, F.round(F.avg(F.col("correct").cast("double")), 3)).alias("correct"),
        F.count_if("leaked").alias("leaks"), F.count_if("blocked").alias("blocked"), F.count_if(~F.col("valid")).alias("invalid_citations"),
    )
    kinds = answers.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("c"))
    each = F.array_join(F.array_sort(F.collect_list(F.concat("outcome", F.lit(":"), "c"))), " ")  # a handful of outcomes
    return sums.join(kinds.groupBy("kind").agg(each.alias("outcomes")), "kind")


def distractors(terms: DataFrame, gold: DataFrame, docs: DataFrame) -> DataFrame:
    """terms(q_id, term), gold(q_id, doc_id) -> (q_id, term, on_gold, elsewhere): documents that hold the word, on and off gold.

    Words (tokens) of documents meet the terms by equality."""
    wanted = terms.select("q_id", "term").distinct()
    words = docs.select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text"), drop_stopwords=False))).alias("term"))
    found = words.join(wanted, "term").join(gold.select("q_id", "doc_id", F.lit(True).alias("__gold")), ["q_id", "doc_id"], "left")
    counts = found.groupBy("q_id", "term").agg(F.count("__gold").alias("on_gold"), F.count_if(F.col("__gold").isNull()).alias("elsewhere"))
    return wanted.join(counts, ["q_id", "term"], "left").na.fill(0, ["on_gold", "elsewhere"])


def traced(stages: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Stage outputs (name, kind, hits(q_id, doc_id, rank, score)) as one table of hits in the order of the stages."""
    out = None
    for no, (name, kind, hits) in enumerate(stages, 1):
        part = hits.select("q_id", F.lit(no).alias("stage_no"), F.lit(name).alias("stage"), F.lit(kind).alias("kind"), "doc_id", "rank", F.col("score").cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def traces(rows: DataFrame) -> DataFrame:
    """`traced` rows as one nested row a question: (q_id, stages: array of (stage_no, stage, kind, hits)), for JSON or Parquet."""
    hits = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))  # a stage's few hits
    per_stage = rows.groupBy("q_id", "stage_no", "stage", "kind").agg(hits.alias("hits"))
    return per_stage.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("stage_no", "stage", "kind", "hits"))).alias("stages"))


def read_traces(nested: DataFrame) -> DataFrame:
    """The inverse of `traces`."""
    stages = nested.select("q_id", F.explode("stages").alias("s")).select("q_id", "s.*")
    return stages.select("q_id", "stage_no", "stage", "kind", F.explode("hits").alias("h")).select("q_id", "stage_no", "stage", "kind", "h.doc_id", "h.rank", "h.score")


def filter_audit(answers: DataFrame, contexts: DataFrame, secrets: list[str]) -> DataFrame:
    """answers(q_id, answer, abstained), contexts(q_id, context) -> (q_id, reasons): answers that the output filter would withhold;
    abstentions and empty answers aren't looked at."""
    rows = answers.where(~F.coalesce("abstained", F.lit(False)) & (F.coalesce("answer", F.lit("")) != "")).join(contexts, "q_id", "left")
    found = rows.select("q_id", tx.filter_reasons(F.col("answer"), F.col("context"), secrets).alias("reasons"))
    return found.where(F.size("reasons") > 0)


def new_uploads(uploads: DataFrame, registry: DataFrame) -> DataFrame:
    """uploads(owner, sha256, chunker, id) without those that the registry(owner, sha256, chunker, state) has in any state but
    failed, and one (the least id) of equal uploads."""
    key = ["owner", "sha256", "chunker"]
    fresh = uploads.join(registry.where("state <> 'failed'").select(*key).distinct(), key, "left_anti")
    return fresh.groupBy(*key).agg(F.min("id").alias("id"))


def newest_first(registry: DataFrame, owner: str, created: str, item: str) -> DataFrame:
    """registry with `nth`, each owner's documents from the newest on; ties by item. Sorted inside (owner, day), counted on over
    days, so an owner of most documents is spread over days."""
    rows = registry.withColumn("__day", F.to_date(created))
    days = rows.groupBy(owner, "__day").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(owner).orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    starts = days.select(F.col(owner).alias("__o"), F.col("__day").alias("__d"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(owner, "__day").orderBy(F.desc(created), item))
    joined = rows.withColumn("__inside", inside).join(starts, F.col(owner).eqNullSafe(F.col("__o")) & F.col("__day").eqNullSafe(F.col("__d")))
    return joined.select(*registry.columns, (F.col("__before") + F.col("__inside")).alias("nth"))


def review_line(number: Column, question: Column, pages: Column) -> Column:
    """One item of a review sheet in Markdown."""
    return F.concat(F.lit("## "), number, F.lit("\n\n"), question, F.lit("\n\n- pages: "), pages, F.lit("\n- [ ] checked\n"))


#: Categories of multi-turn golden items, and what they may expect.
CATEGORIES, EXPECT = ("pronoun_follow_up", "standalone", "topic_switch", "constraint_follow_up", "ambiguous_follow_up"), ("answer", "clarify")


def golden_conversation_problems(items: DataFrame) -> DataFrame:
    """items(id, category, message, standalone, expect, turns, gold_pages, must_contain) -> (id, problem) for every broken rule."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = {
        "unknown category": ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "unknown expectation": ~F.coalesce(F.col("expect").isin(*EXPECT), F.lit(False)), "no message": blank("message"), "no prior turn": size("turns") == 0,
        "answer without standalone question": (F.col("expect") == "answer") & blank("standalone"), "answer without pages": (F.col("expect") == "answer") & (size("gold_pages") == 0),
        "clarify names fewer than two": (F.col("expect") == "clarify") & (size("must_contain") < 2), "clarify outside its category": (F.col("expect") == "clarify") & (F.col("category") != "ambiguous_follow_up"),
        "standalone question differs from message": (F.col("category") == "standalone") & (_same_question("message") != _same_question("standalone")),
    }
    found = items.select("id", F.explode(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items()))).alias("problem")).where("problem IS NOT NULL")
    again = items.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    return found.unionByName(again)


def _same_question(c: str) -> Column:
    """Lower case, single spaces, without the marks at the end."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    return F.regexp_replace(plain, "[?.!]+$", "")


def qualified(chunks: DataFrame, doc: Column, source: Column) -> DataFrame:
    """chunks with chunk_id made unique over all documents (document, colon, id; a null document is 'none') and tagged with its source."""
    return chunks.withColumns({"chunk_id": F.concat(F.coalesce(doc.cast("string"), F.lit("none")), F.lit(":"), "chunk_id"), "source": source})


def cited_passages(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """answers(q_id, answer), contexts(q_id, rank, doc_id) -> (q_id, place, cited, doc_id): each different citation [Sn] of an answer, in the
    order of the text, with the passage that stands n-th in its context; null where there is none. A null answer cites nothing."""
    cited = answers.select("q_id", F.posexplode(tx.citations(F.coalesce("answer", F.lit(""))))).select("q_id", F.col("pos").alias("place"), F.col("col").cast("long").alias("cited"))
    passages = contexts.select("q_id", F.col("rank").cast("long").alias("cited"), "doc_id").dropDuplicates(["q_id", "cited"])
    return cited.join(passages, ["q_id", "cited"], "left").select("q_id", "place", "cited", "doc_id")


def run_rows(questions: DataFrame, traces: DataFrame, judged: DataFrame) -> DataFrame:
    """questions(q_id, ..), traces(q_id, answer, error), judged(q_id, correct) -> a row a question: its columns, answer, correct, and state:
    `missing` without a trace, `failed` with an error, `unjudged` without a verdict, else `judged`. One trace and verdict a question."""
    rows = questions.join(traces.select("q_id", "answer", "error", F.lit(True).alias("__run")), "q_id", "left").join(judged.select("q_id", "correct"), "q_id", "left")
    state = F.when(F.col("__run").isNull(), "missing").when(F.col("error").isNotNull(), "failed").when(F.col("correct").isNull(), "unjudged").otherwise("judged")
    return rows.withColumn("state", state).drop("__run", "error")


def write_report(path: str, questions: DataFrame, summary: DataFrame) -> None:
    """An evaluation run under path: `per_question.jsonl`, a line a question, and `report.json`, the one row of the summary; both as folders."""
    lines = lambda df: df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines(questions).write.text(f"{path}/per_question.jsonl")
    lines(summary).coalesce(1).write.text(f"{path}/report.json")  # one row
