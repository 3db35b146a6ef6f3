"""Registered queries of experiment tables, traces and registries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _ARMS, _BM25_30, _OVERLAP, _TOKS, _filter_sql, _second_list, query
from .functions import text as tx
from .jobs import evaluate
from .operators import reports
from .sources.tables import table as t

_ARM_COLUMNS = {"off": "toxic = 0 AND quality = 1", "on": "doc_id % 2 = 0 OR quality = 1", "best": "quality = 1 OR toxic = 0"}


def _arms(spark, sf_dir: str):
    return t(spark, sf_dir, "labels").select("doc_id", "quality", *(F.expr(f"cast(({c}) AS int)").alias(a) for a, c in _ARM_COLUMNS.items()))


@query(f"""WITH a AS ({_ARMS}), l AS (UNPIVOT a ON off, "on", best INTO NAME arm VALUE hit) SELECT lang, arm, count(*) AS n, round(avg(hit), 3) AS hit, round(avg(hit / (1 + item % 4)), 3) AS mrr, round(avg(hit * 0.5e0), 3) AS recall FROM l JOIN documents ON item = doc_id GROUP BY lang, arm""")
def arm_means(spark, sf_dir):
    """Three arms over the labelled documents, by language."""
    rows = _arms(spark, sf_dir).join(t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    each = rows.select("lang", "doc_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, _ARM_COLUMNS)), F.array(*_ARM_COLUMNS))).alias("arm", "hit"))
    return reports.arm_means(each.select("lang", "arm", "hit", (F.col("hit") / (1 + F.col("doc_id") % 4)).alias("mrr"), (F.col("hit") * 0.5).alias("recall")), ["lang"])


@query(f"""WITH a AS ({_ARMS}) SELECT lang AS category, count(*) AS n, count(*) FILTER (item % 3 = 0) AS gate_fired, count(*) FILTER (item % 5 = 0) AS asked, round(avg(off), 3) AS hit_off, round(avg("on"), 3) AS hit_on, round(avg(best), 3) AS hit_best,
count(*) FILTER ("on" > off) AS wins, count(*) FILTER ("on" < off) AS losses, count(*) FILTER ("on" = off) AS ties FROM a JOIN documents ON item = doc_id GROUP BY lang""")
def category_table(spark, sf_dir):
    rows = _arms(spark, sf_dir).join(t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category")), "doc_id")
    return reports.category_table(rows.withColumn("fired", F.col("doc_id") % 3 == 0).withColumn("asked", F.col("doc_id") % 5 == 0), list(_ARM_COLUMNS))


_STATUS = "CASE WHEN turn % 5 = 0 THEN 'fallback' WHEN text LIKE '%?%' THEN 'rewritten' ELSE 'skipped' END"


@query(f"""WITH r AS (SELECT {_STATUS} AS status, CASE WHEN length(text) > 200 THEN 'too_long' ELSE 'unparsed' END AS reason FROM conversations), x AS (SELECT 'status' AS kind, status AS value FROM r UNION ALL SELECT 'reason', reason FROM r WHERE status = 'fallback')
SELECT kind, value, count(*) AS n FROM x GROUP BY ALL""")
def status_counts(spark, sf_dir):
    return reports.status_counts(t(spark, sf_dir, "conversations").select(F.expr(_STATUS).alias("status"), F.when(F.length("text") > 200, "too_long").otherwise("unparsed").alias("reason")))


@query("""WITH r AS (SELECT user_id % 2 + 1 AS place, avg((value > 50)::INT) AS hit, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY ALL), b AS (SELECT max(hit) FILTER (place = 1) AS h1, max(hit) FILTER (place = 2) AS h2, max(p50) FILTER (place = 1) AS p1, max(p50) FILTER (place = 2) AS p2 FROM r)
SELECT CASE WHEN 100 * (h2 - h1) > 8 THEN 'rewriter 2' WHEN 100 * (h1 - h2) > 8 THEN 'rewriter 1' WHEN p2 < p1 THEN 'rewriter 2' ELSE 'rewriter 1' END AS chosen, CASE WHEN abs(100 * (h2 - h1)) > 8 THEN 'on hit@5 higher by more than the band' ELSE 'inside the band; lower p50 latency' END AS reason FROM b""")
def rewriter_choice(spark, sf_dir):
    """Two rewriters by their hits and latencies; events stand for calls."""
    rows = t(spark, sf_dir, "events").groupBy((F.col("user_id") % 2 + 1).alias("place")).agg(F.avg((F.col("value") > 50).cast("double")).alias("hit"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"))
    return reports.chosen_rewriter(rows.withColumn("spec", F.concat(F.lit("rewriter "), "place")), 8.0)


@query(f"""WITH a AS MATERIALIZED ({_BM25_30}), f AS (SELECT q_id, list(doc_id ORDER BY rank) AS ids FROM a WHERE rank <= 5 GROUP BY q_id), n AS (SELECT q_id, list(doc_id ORDER BY rank) AS ids FROM (SELECT q_id, doc_id, rank FROM a WHERE rank <= 5 AND NOT (q_id % 4 = 1 AND rank = 5)) GROUP BY q_id)
SELECT count(*) AS n, count(*) FILTER (f.ids = n.ids) AS identical, count(*) FILTER (f.ids IS DISTINCT FROM n.ids) AS changed FROM f LEFT JOIN n USING (q_id)""")
def regression_arm(spark, sf_dir):
    """Contexts of all questions against contexts that lost their last document for some."""
    hits = evaluate.keyword_hits(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark"), 5).withColumnRenamed("doc_id", "chunk_id")
    return reports.regression(hits, hits.where("NOT (q_id % 4 = 1 AND rank = 5)"))


@query("""WITH r AS (SELECT unnest(['on', 'on_original']) AS arm, unnest([CASE WHEN doc_id % 9 > 0 THEN quality = 1 END, toxic = 0]) AS correct FROM labels), s AS (SELECT arm, count(*) FILTER (correct) AS correct, count(correct) AS judged, round(count(*) FILTER (correct) / nullif(count(correct), 0)::DOUBLE, 3) AS rate FROM r GROUP BY arm)
SELECT arm, correct, judged, rate, CASE WHEN 100 * (max(rate) FILTER (arm = 'on_original') OVER () - max(rate) FILTER (arm = 'on') OVER ()) > 8 THEN 'original message' ELSE 'rewritten question' END AS keep FROM s""")
def answer_arms(spark, sf_dir):
    arm = lambda name, c: F.struct(F.lit(name).alias("arm"), F.expr(c).alias("correct"))
    rows = t(spark, sf_dir, "labels").select(F.explode(F.array(arm("on", "CASE WHEN doc_id % 9 > 0 THEN quality = 1 END"), arm("on_original", "toxic = 0"))).alias("x")).select("x.*")
    return reports.answer_arms(rows, 8.0)


_GOLD = "g AS MATERIALIZED (SELECT item_id AS q_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_TWO = f"a AS MATERIALIZED ({_BM25_30}), d AS MATERIALIZED (SELECT doc_id, {_TOKS.format(c='text')} AS ts FROM documents), asked AS MATERIALIZED (SELECT DISTINCT item_id AS q_id, unnest({_TOKS.format(c='text')}) AS term FROM benchmark), b AS MATERIALIZED ({_OVERLAP})"


@query(f"""WITH {_TWO}, {_GOLD}, h AS (SELECT DISTINCT q_id FROM g), u AS (SELECT 'bm25' AS config, q_id, doc_id, rank FROM a UNION ALL SELECT 'overlap', q_id, doc_id, rank FROM b), m AS (SELECT config, q_id, min(rank) AS best FROM u JOIN g USING (q_id, doc_id) GROUP BY ALL),
r AS (SELECT c.config, h.q_id, best FROM h CROSS JOIN (SELECT unnest(['bm25', 'overlap']) AS config) c LEFT JOIN m ON m.q_id = h.q_id AND m.config = c.config)
SELECT config, count(*) AS n, round(avg(coalesce((best <= 1)::INT, 0)), 3) AS hit_1, round(avg(coalesce((best <= 5)::INT, 0)), 3) AS hit_5, round(avg(coalesce(1e0 / best, 0e0)), 3) AS mrr, round(avg(coalesce((best <= 30)::INT, 0)), 3) AS candidates, round(avg(length(text)), 1) AS ms, count(*) FILTER (best IS NULL) AS failures
FROM r JOIN benchmark ON item_id = q_id GROUP BY config""")
def retrieval_table(spark, sf_dir):
    """Two configurations over all questions that have gold documents; the length of a question stands for its time."""
    docs, bench = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    gold = evaluate.gold(docs, bench)
    found = reports.traced([("bm25", "retrieve", evaluate.keyword_hits(docs, bench, 30)), ("overlap", "retrieve", _second_list(spark, sf_dir))])
    best = found.join(gold, ["q_id", "doc_id"]).groupBy(F.col("stage").alias("config"), "q_id").agg(F.min("rank").alias("best"))
    asked = gold.select("q_id").distinct().join(bench.select(F.col("item_id").alias("q_id"), F.length("text").alias("ms")), "q_id")
    every = asked.withColumn("config", F.explode(F.array(F.lit("bm25"), F.lit("overlap")))).join(best, ["config", "q_id"], "left")
    return reports.retrieval_table(every.withColumn("failure", F.when(F.col("best").isNull(), "retrieval_miss").otherwise("retrieval_ok")), ["config"])


@query(f"""WITH e AS (SELECT item_id AS q_id, list_distinct(list_filter(regexp_extract_all(lower(text), '{tx.TOKEN}'), lambda w: length(w) >= 8)) AS facts FROM benchmark)
SELECT doc_id AS id, len(list_filter(facts, lambda x: contains(lower(coalesce(text, '')), x)))::INT AS stated, len(facts)::INT AS total FROM documents JOIN e ON q_id = doc_id % (SELECT max(item_id) + 1 FROM benchmark)""")
def fact_counts(spark, sf_dir):
    """How many long words of a passage each document states; passages are dealt to documents by number."""
    facts = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.filter(F.array_distinct(tx.tokens(F.col("text"), False)), lambda w: F.length(w) >= 8).alias("facts"))
    n = facts.agg(F.max("k") + 1).first()[0] or 1
    rows = t(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % n).join(facts, "k")
    return reports.fact_counts(rows.select(F.col("doc_id").alias("id"), "text", "facts"))


@query(f"""SELECT count(*) FILTER (item % 3 <> 1) AS eligible, count(*) FILTER (item % 3 <> 1 AND off = 0) AS discriminating, count(*) FILTER (best = 0) AS oracle_misses, count(*) FILTER (off = best) AS controls FROM ({_ARMS})""")
def check_set_summary(spark, sf_dir):
    return reports.check_set(_arms(spark, sf_dir).withColumn("eligible", F.col("doc_id") % 3 != 1).withColumnRenamed("best", "oracle"))


_OUTCOME = "CASE WHEN doc_id % 10 = 0 THEN 'unjudged' WHEN quality = 1 THEN 'ok' ELSE 'generation_fail' END"


@query(f"""WITH a AS (SELECT lang AS kind, {_OUTCOME} AS outcome, CASE WHEN doc_id % 10 > 0 THEN quality END AS correct, toxic = 1 AS leaked, doc_id % 6 = 0 AS blocked, doc_id % 8 > 0 AS valid FROM labels JOIN documents USING (doc_id)),
k AS (SELECT kind, string_agg(outcome || ':' || c, ' ' ORDER BY outcome || ':' || c) AS outcomes FROM (SELECT kind, outcome, count(*) AS c FROM a GROUP BY ALL) GROUP BY kind)
SELECT kind, count(*) AS n, count(*) FILTER (outcome = 'unjudged') AS unjudged, CASE WHEN count(*) FILTER (outcome = 'unjudged') / count(*) <= 0.25 THEN round(avg(correct), 3) END AS correct, count(*) FILTER (leaked) AS leaks, count(*) FILTER (blocked) AS blocked, count(*) FILTER (NOT valid) AS invalid_citations, any_value(outcomes) AS outcomes FROM a JOIN k USING (kind) GROUP BY kind""")
def answer_report(spark, sf_dir):
    rows = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind")), "doc_id")
    return reports.answer_report(rows.select("kind", F.expr(_OUTCOME).alias("outcome"), F.expr("CASE WHEN doc_id % 10 > 0 THEN quality END").alias("correct"), F.expr("toxic = 1").alias("leaked"), F.expr("doc_id % 6 = 0").alias("blocked"), F.expr("doc_id % 8 > 0").alias("valid")))


@query(f"""WITH {_GOLD}, e AS (SELECT DISTINCT item_id AS q_id, unnest(list_filter(regexp_extract_all(lower(text), '{tx.TOKEN}'), lambda w: length(w) >= 9)) AS term FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS term FROM documents)
SELECT e.q_id, e.term, count(g.doc_id) AS on_gold, count(w.doc_id) - count(g.doc_id) AS elsewhere FROM e LEFT JOIN w USING (term) LEFT JOIN g ON g.q_id = e.q_id AND g.doc_id = w.doc_id GROUP BY e.q_id, e.term""")
def distractors(spark, sf_dir):
    """Where the long words of each question stand, on its gold documents and elsewhere."""
    docs, bench = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    terms = bench.select(F.col("item_id").alias("q_id"), F.explode(tx.tokens(F.col("text"), False)).alias("term")).where("length(term) >= 9")
    return reports.distractors(terms, evaluate.gold(docs, bench), docs)


@query(f"""WITH {_TWO}, u AS (SELECT q_id, 1 AS stage_no, 'bm25' AS stage, 'retrieve' AS kind, doc_id, rank, score FROM a UNION ALL SELECT q_id, 2, 'overlap', 'retrieve', doc_id, rank, score FROM b UNION ALL SELECT q_id, 3, 'context', 'transform', doc_id, rank, score FROM a WHERE rank <= 5)
SELECT q_id, stage_no, stage, kind, doc_id, rank, score FROM u""")
def stage_trace(spark, sf_dir):
    """Hits of three stages of every question, nested into traces and read again."""
    hits = evaluate.keyword_hits(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark"), 30)
    rows = reports.traced([("bm25", "retrieve", hits), ("overlap", "retrieve", _second_list(spark, sf_dir)), ("context", "transform", hits.where("rank <= 5"))])
    return reports.read_traces(reports.traces(rows)).withColumn("rank", F.col("rank").cast("long"))


_SAID = "CASE conv_id % 5 WHEN 1 THEN text || ' see https://evil.example/p' WHEN 2 THEN text || ' ![x][y]' ELSE text END"


@query(f"""WITH z AS (SELECT conv_id, turn, {_SAID} AS answer, turn % 3 = 2 AS abstained, CASE WHEN conv_id % 2 = 0 THEN 'at https://evil.example/p' END AS ctx FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, array_to_string(r, ',') AS reasons FROM (SELECT conv_id, turn, {_filter_sql('answer')} AS r FROM z WHERE NOT abstained AND coalesce(answer, '') <> '') WHERE len(r) > 0""")
def filter_audit(spark, sf_dir):
    """Answers of a run that the output filter would withhold."""
    rows = t(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("q_id", F.struct("conv_id", "turn"))
    contexts = rows.where("conv_id % 2 = 0").select("q_id", F.lit("at https://evil.example/p").alias("context"))
    found = reports.filter_audit(rows.select("q_id", F.expr(_SAID).alias("answer"), F.expr("turn % 3 = 2").alias("abstained")), contexts, ["internal reference"])
    return found.select("q_id.conv_id", "q_id.turn", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH u AS (SELECT coalesce(source, '') AS owner, sha256(coalesce(text, '')) AS sha256, lang AS chunker, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'ready' END AS state FROM documents)
SELECT owner, sha256, chunker, min(id) AS id FROM u WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM u r WHERE r.id % 2 = 0 AND r.state <> 'failed' AND r.owner = u.owner AND r.sha256 = u.sha256 AND r.chunker = u.chunker) GROUP BY ALL""")
def upload_dedupe(spark, sf_dir):
    """Uploads (odd ids) that their owner hasn't stored yet; stored ones that failed don't count."""
    rows = t(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("owner"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("lang").alias("chunker"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("ready").alias("state"))
    return reports.new_uploads(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth FROM events")
def owner_listing(spark, sf_dir):
    """Each user's events, newest first; they stand for documents."""
    return reports.newest_first(t(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {_GOLD}, p AS (SELECT q_id, string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) AS pages FROM g GROUP BY q_id)
SELECT item_id AS q_id, '## ' || item_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '- pages: ' || coalesce(pages, 'none') || chr(10) || '- [ ] checked' || chr(10) AS line FROM benchmark LEFT JOIN p ON q_id = item_id""")
def review_sheet(spark, sf_dir):
    """A review sheet's item for every question, with the documents that hold it."""
    docs, bench = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    pages = evaluate.gold(docs, bench).groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ", ").alias("pages"))
    rows = bench.select(F.col("item_id").alias("q_id"), "text").join(pages, "q_id", "left")
    return rows.select("q_id", reports.review_line(F.col("q_id"), F.col("text"), F.coalesce("pages", F.lit("none"))).alias("line"))


_ITEM = """conv_id AS id, CASE conv_id % 6 WHEN 0 THEN 'pronoun_follow_up' WHEN 1 THEN 'standalone' WHEN 2 THEN 'topic_switch' WHEN 3 THEN 'ambiguous_follow_up' WHEN 4 THEN 'constraint_follow_up' ELSE 'other' END AS category, text AS message,
CASE WHEN conv_id % 4 = 0 THEN '' WHEN conv_id % 4 = 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '?' ELSE text || ' too' END AS standalone, CASE WHEN conv_id % 5 = 3 THEN 'clarify' WHEN conv_id % 5 = 4 THEN 'guess' ELSE 'answer' END AS expect"""


@query(rf"""WITH i AS (SELECT {_ITEM}, turn AS n_turns, conv_id % 3 AS n_pages, conv_id % 4 AS n_names FROM conversations WHERE role = 'user'), f AS (SELECT *, regexp_replace(trim(regexp_replace(lower(coalesce(message, '')), '[\x20\x09-\x0D]+', ' ', 'g')), '[?.!]+$', '') AS a, regexp_replace(trim(regexp_replace(lower(coalesce(standalone, '')), '[\x20\x09-\x0D]+', ' ', 'g')), '[?.!]+$', '') AS b FROM i)
SELECT id, problem FROM (SELECT id, unnest([CASE WHEN category = 'other' THEN 'unknown category' END, CASE WHEN expect = 'guess' THEN 'unknown expectation' END, CASE WHEN trim(coalesce(message, '')) = '' THEN 'no message' END, CASE WHEN n_turns = 0 THEN 'no prior turn' END,
CASE WHEN expect = 'answer' AND trim(coalesce(standalone, '')) = '' THEN 'answer without standalone question' END, CASE WHEN expect = 'answer' AND n_pages = 0 THEN 'answer without pages' END, CASE WHEN expect = 'clarify' AND n_names < 2 THEN 'clarify names fewer than two' END,
CASE WHEN expect = 'clarify' AND category <> 'ambiguous_follow_up' THEN 'clarify outside its category' END, CASE WHEN category = 'standalone' AND a <> b THEN 'standalone question differs from message' END]) AS problem FROM f) WHERE problem IS NOT NULL
UNION ALL SELECT id, 'repeated id' FROM i GROUP BY id HAVING count(*) > 1""")
def golden_conversations(spark, sf_dir):
    """Rules of multi-turn golden items over items made of conversations' questions."""
    some = lambda n: F.expr(f"slice(array('a', 'b', 'c', 'd'), 1, cast({n} AS int))")
    items = t(spark, sf_dir, "conversations").where("role = 'user'").selectExpr(*_split(_ITEM), "turn", "conv_id")
    return reports.golden_conversation_problems(items.withColumn("turns", some("turn")).withColumn("gold_pages", some("conv_id % 3")).withColumn("must_contain", some("conv_id % 4")))


def _split(items: str) -> list[str]:
    """Select items at commas outside parentheses and CASE."""
    out, depth, now = [], 0, ""
    for part in items.replace("\n", " ").split(","):
        now = f"{now},{part}" if now else part
        depth = now.count("(") - now.count(")") + now.count("CASE ") - now.count(" END")
        if depth == 0:
            out.append(now.strip())
            now = ""
    return out


@query(r"""WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(coalesce(text, '') || CASE conv_id % 3 WHEN 0 THEN ' [S2] and [S1], [S2]' WHEN 1 THEN ' [S9]' ELSE '' END, '\[S(\d+)\]', 1), lambda n: TRY_CAST(n AS BIGINT)) AS cited FROM conversations WHERE role = 'assistant'),
d AS (SELECT conv_id, turn, list_filter(cited, lambda n, i: i = 1 OR NOT list_has_any([n], cited[1:i - 1])) AS cited FROM c), e AS (SELECT conv_id, turn, unnest(range(0, len(cited))) AS place, cited FROM d)
SELECT conv_id, turn, place::INT AS place, cited[place + 1] AS cited, CASE WHEN cited[place + 1] BETWEEN 1 AND 5 THEN conv_id * 10 + cited[place + 1] END AS doc_id FROM e""")
def cited_passages(spark, sf_dir):
    """Citations of every answer with the passages of its context, five to an answer, by their place."""
    said = t(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("q_id", F.struct("conv_id", "turn"))
    answers = said.select("q_id", F.expr("coalesce(text, '') || CASE conv_id % 3 WHEN 0 THEN ' [S2] and [S1], [S2]' WHEN 1 THEN ' [S9]' ELSE '' END").alias("answer"))
    contexts = said.select("q_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"), "conv_id").select("q_id", "rank", (F.col("conv_id") * 10 + F.col("rank")).alias("doc_id"))
    found = reports.cited_passages(answers, contexts)
    return found.select("q_id.conv_id", "q_id.turn", "place", "cited", "doc_id")


@query("""SELECT doc_id AS q_id, CASE WHEN doc_id % 7 > 0 THEN lang END AS answer, CASE WHEN doc_id % 7 > 0 THEN quality END AS correct, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 1 THEN 'failed' WHEN quality IS NULL THEN 'unjudged' ELSE 'judged' END AS state
FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels WHERE doc_id % 7 > 0) USING (doc_id)""")
def run_rows(spark, sf_dir):
    """Questions (one a document), the runs that there are, and the verdicts that there are."""
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("q_id"), "lang")
    traces = docs.where("q_id % 7 > 0").select("q_id", F.col("lang").alias("answer"), F.when(F.col("q_id") % 11 == 1, "timed out").alias("error"))
    return reports.run_rows(docs.select("q_id"), traces, t(spark, sf_dir, "labels").where("doc_id % 7 > 0").select(F.col("doc_id").alias("q_id"), F.col("quality").alias("correct")))
