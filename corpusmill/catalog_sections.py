"""Registered queries of sections, parents, pasted objects and checked sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _TOKS, ORACLES, query
from .functions import text as tx
from .operators import ann, arms, conversations, evaluation, overlap, retrieval, sections, versions
from .sources import pasted, sets
from .sources.scratch import scratch_path, stored
from .sources.tables import table as t

_TITLED = "replace(coalesce(text, ''), '{nl}', '{nl}Notes on ' || coalesce(lang, 'und') || '{nl}')"
#: Titles of every document: number, page (a half of the text), level, title.
_TITLES = [(1, 0, 1, "'Chapter 1. Notes on ' || coalesce(lang, 'und')"), (2, 0, 3, "'notes  ON ' || coalesce(lang, 'und')"), (3, 1, 2, "'A title that''s missing'"), (4, 1, 3, "'Notes on ' || coalesce(lang, 'und')"), (5, 1, 2, "'Another one'")]


def _titled(spark, sf_dir):
    """Documents with a title after every line, and their tables of titles."""
    docs = t(spark, sf_dir, "documents").selectExpr("doc_id", "lang", _TITLED.format(nl="\\n") + " AS text")
    entry = lambda o, p, level, title: F.expr(f"named_struct('ord', {o}, 'page', {p}, 'page_start', {p} * floor(length(text) / 2), 'page_end', if({p} = 0, floor(length(text) / 2), length(text)), 'level', {level}, 'title', {title.replace(chr(39) * 2, chr(92) + chr(39))})")
    return docs.select("doc_id", "text"), docs.select("doc_id", F.explode(F.array(*(entry(*e) for e in _TITLES))).alias("e")).select("doc_id", "e.*")


_ENTRIES = " UNION ALL ".join(f"SELECT doc_id, {o} AS ord, {p} AS page, {p} * (length(text) // 2) AS ps, CASE WHEN {p} = 0 THEN length(text) // 2 ELSE length(text) END AS pe, {level} AS level, {title} AS title FROM d" for o, p, level, title in _TITLES)
_PAT = r"""'(?mi)^\s*(?:(?:chapter|part)\s+[\dIVX]+\s+)?' || array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(title, '^(?:Chapter|Part)\s+[\dIVX]+\.\s*', ''), '\s+'), lambda w: w <> ''), lambda w: replace(regexp_replace(w, '([^\w\s])', '\\\1', 'g'), '\''', '[''’]')), '\s+') || '\s*$'"""
_SECTIONS = rf"""d AS MATERIALIZED (SELECT doc_id, lang, {_TITLED.format(nl="' || chr(10) || '")} AS text FROM documents), e AS MATERIALIZED (SELECT *, {_PAT} AS pat FROM ({_ENTRIES})),
f(doc_id, ord, here, page, stack, mark) AS (SELECT doc_id, 0, -1::BIGINT, -1, []::STRUCT(level INT, title VARCHAR)[], NULL::STRUCT(s BIGINT, level INT, path VARCHAR[]) FROM d
UNION ALL SELECT doc_id, ord, coalesce(pos, here), CASE WHEN pos IS NULL THEN last_page ELSE page END, CASE WHEN pos IS NULL THEN stack ELSE above END, CASE WHEN pos IS NOT NULL THEN {{'s': pos, 'level': level, 'path': list_transform(above, lambda x: x.title)}} END
FROM (SELECT *, list_append(list_filter(stack, lambda x: x.level < level), {{'level': level, 'title': title}}) AS above, CASE WHEN regexp_matches(sub, pat) THEN b - m + len(string_split_regex(sub, pat)[1]) + len(regexp_extract(sub, pat)) - len(ltrim(regexp_extract(sub, pat), chr(10) || ' ' || chr(9) || chr(13))) WHEN page <> last_page THEN ps END AS pos
FROM (SELECT *, CASE WHEN b > 0 AND text[b] <> chr(10) THEN 1 ELSE 0 END AS m, (CASE WHEN b > 0 AND text[b] <> chr(10) THEN chr(1) ELSE '' END) || substring(text, b + 1, greatest(pe - b, 0)) AS sub
FROM (SELECT e.*, f.here, f.page AS last_page, f.stack, d.text, CASE WHEN e.page = f.page THEN greatest(ps, f.here + 1) ELSE ps END AS b FROM f JOIN e ON e.doc_id = f.doc_id AND e.ord = f.ord + 1 JOIN d ON d.doc_id = f.doc_id)))),
k AS (SELECT doc_id, ord, mark.s AS s, mark.level AS level, mark.path AS path FROM f WHERE mark IS NOT NULL),
a AS (SELECT * FROM k UNION ALL SELECT doc_id, 0, 0, 1, ['{sections.BODY}'] FROM d WHERE coalesce((SELECT arg_min(k.s, k.ord) FROM k WHERE k.doc_id = d.doc_id), 1) > 0),
s AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i, s, e, level, path FROM (SELECT a.*, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY ord), length(text)) AS e FROM a JOIN d USING (doc_id)) WHERE e > s)"""
_WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"


@query(f"""WITH RECURSIVE {_SECTIONS} SELECT doc_id, s AS start, e AS "end", level::BIGINT AS level, array_to_string(path, ' > ') AS path, {_WORDS.format("substring(text, s + 1, e - s)")} AS words FROM s JOIN d USING (doc_id)""")
def titled_sections(spark, sf_dir):
    """Sections of every document by its table of titles, with a title planted after each line."""
    rows = sections.with_sections(sections.with_marks(*_titled(spark, sf_dir))).select("doc_id", F.explode("sections").alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.level", F.array_join("s.path", " > ").alias("path"), "s.words")


@query(f"""WITH RECURSIVE {_SECTIONS}, w AS (SELECT s.*, text FROM s JOIN d USING (doc_id)),
g(doc_id, i, s, e, level, path, closed, text) AS (SELECT doc_id, i, s, e, level, path, 0::BIGINT, text FROM w WHERE i = 1
UNION ALL SELECT w.doc_id, w.i, CASE WHEN j THEN x.s ELSE w.s END, w.e, w.level, w.path, x.closed + CASE WHEN j THEN 0 ELSE 1 END, w.text FROM (SELECT g.*, {_WORDS.format("substring(g.text, g.s + 1, g.e - g.s)")} < 120 AS brief FROM g) x JOIN (SELECT *, level > 2 AS deep FROM w) w ON w.doc_id = x.doc_id AND w.i = x.i + 1, LATERAL (SELECT x.brief AND w.deep AS j))
SELECT doc_id, closed::INT AS section, s AS start, e AS "end", level::BIGINT AS level, array_to_string(path, ' > ') AS path, {_WORDS.format("substring(text, s + 1, e - s)")} AS words FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, closed ORDER BY i DESC) = 1""")
def parent_sections(spark, sf_dir):
    """The sections joined so that parents have 120 words where the levels allow it."""
    rows = sections.merged(sections.with_sections(sections.with_marks(*_titled(spark, sf_dir))), 120).select("doc_id", F.posexplode("sections").alias("section", "s"))
    return rows.select("doc_id", "section", "s.start", "s.end", "s.level", F.array_join("s.path", " > ").alias("path"), "s.words")


@query()
def section_children(spark, sf_dir):
    """Children of every document's parents, each with its parent's place and path."""
    return sections.parents_and_children(*_titled(spark, sf_dir))


_FAULTS = {
    0: ("""{"id": "p~", "question": "^", "answerable": true, "gold_pages": [[1, 2]], "notes": "ok"}""", ("^", "ok", "", None)), 1: ("""{"id": "p~", "question": "^", "notes": "said "so" twice"}""", ("^", 'said "so" twice', pasted.NOTES, None)),
    2: ("""{"id": "p~", "question": "^ \\d", "notes": ""}""", ("^ d", "", pasted.ESCAPES, None)), 3: ("""{"id": "p~", "question": "^ &gt; x", "notes": "n"}""", ("^ > x", "n", pasted.ENTITIES, None)),
    4: ("""{"id": "p~", "question": }""", None), 5: ("""{"id": "p~", "question": "^", "answerable": true, "gold_pages": [1, 2], "must_not_contain": "x", "notes": "m"}""", ("^", "m", pasted.LISTED, "gold_pages is not a list of [start, end] pairs")),
}


def _sql(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _case(part: int) -> str:
    return "CASE page_id % 6 " + " ".join(f"WHEN {k} THEN {_sql(good[part] if good else None)}" for k, (_, good) in _FAULTS.items()) + " END"


@query(f"""WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[^A-Za-z0-9:/._-]', '', 'g') AS q FROM pages)
SELECT page_id, 0 AS nth, 'p' || page_id AS id, replace({_case(0)}, '^', q) AS question, {_case(1)} AS notes, {_case(2)} AS repairs, {_case(3)} AS problem FROM p WHERE page_id % 6 <> 4
UNION ALL SELECT page_id, 0, NULL, NULL, NULL, NULL, 'not a JSON object' FROM p WHERE page_id % 6 = 4
UNION ALL SELECT page_id, 1, 'q' || page_id, q, 'fine', '', NULL FROM p""")
def pasted_questions(spark, sf_dir):
    """Questions pasted from every page, most of them with a fault planted: what comes back, its repairs, and what is set aside."""
    case = "CASE page_id % 6 " + " ".join(f"WHEN {k} THEN r'{raw}'" for k, (raw, _) in _FAULTS.items()) + " END"
    rows = t(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[^A-Za-z0-9:/._-]", "").alias("q"), F.expr(case).alias("raw"))
    second = F.concat(F.lit('{"id": "q'), "page_id", F.lit('", "question": "'), "q", F.lit('", "notes": "fine"}'))
    text = F.concat(F.replace(F.replace("raw", F.lit("~"), F.col("page_id").cast("string")), F.lit("^"), F.col("q")), F.lit("\n  "), second)
    good, rejects = pasted.questions(pasted.pieces(rows.select("page_id", text.alias("text")), "page_id"))
    made = good.select(F.col("source").alias("page_id"), "nth", "id", "question", "notes", F.array_join("repairs", "; ").alias("repairs"), "problem")
    none = F.lit(None).cast("string")
    return made.unionByName(rejects.select(F.col("source").alias("page_id"), "nth", none.alias("id"), none.alias("question"), none.alias("notes"), none.alias("repairs"), F.col("reason").alias("problem")))


_CHUNK_FAULTS = "CASE WHEN doc_id % 31 = 3 THEN 'not a row of the schema' WHEN doc_id % 31 = 5 THEN 'unknown key: page' WHEN doc_id % 31 = 7 THEN 'no chunk_id' WHEN doc_id % 31 = 9 THEN 'ends before it begins' WHEN doc_id % 31 = 11 THEN 'parent isn''t in the set'  END"


@query(f"""WITH f AS (SELECT 'chunks' AS tab, doc_id, {_CHUNK_FAULTS} AS reason FROM documents), k AS (SELECT doc_id // 10 AS g, count(*) AS n FROM documents GROUP BY 1)
SELECT tab AS "table", coalesce(reason, 'fine') AS reason, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'chunks', 'repeated id', count(*) FROM documents WHERE doc_id % 31 = 13 HAVING count(*) > 0 UNION ALL SELECT 'parents', 'fine', count(*) FILTER (n > 0) FROM k""")
def chunkset_checks(spark, sf_dir):
    """Chunks and parents of every document as JSON lines with faults planted: how many rows are good, and why others are set aside."""
    docs = t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 31).alias("f"))
    name = F.when(F.col("f") == 7, "").otherwise(F.concat(F.lit("fixed-"), "doc_id"))
    parent = F.concat(F.lit("parent-"), F.when(F.col("f") == 11, "none").otherwise((F.col("doc_id") / 10).cast("long").cast("string")))
    row = F.struct(name.alias("chunk_id"), "text", F.lit(3).alias("page_start"), F.when(F.col("f") == 9, 2).otherwise(4).alias("page_end"), F.lit("fixed").alias("strategy"), parent.alias("parent_id"), F.when(F.col("f") == 5, 1).alias("page"))
    line = F.when(F.col("f") == 3, F.concat(F.lit("{"), F.to_json(row))).otherwise(F.to_json(row)).alias("line")
    lines = docs.select(line, F.explode(F.when((F.col("f") == 13), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    above = docs.select(((F.col("doc_id") / 10).cast("long")).alias("g")).distinct().select(F.to_json(F.struct(F.concat(F.lit("parent-"), "g").alias("chunk_id"), F.lit("").alias("text"))).alias("line"))
    rows, parents, rejects = sets.checked_chunks(lines.select("line"), above)
    fine = lambda df, tab: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(tab).alias("table"), F.lit("fine").alias("reason"), "n")
    twice = fine(rows, "chunks").unionByName(fine(parents, "parents"))
    return twice.unionByName(rejects.groupBy("table", "reason").agg(F.count(F.lit(1)).alias("n")))


@query("""WITH o AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 17 <> 3), n AS (SELECT doc_id, CASE WHEN doc_id % 19 = 4 THEN coalesce(text, '') || ' more' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 23 <> 7)
SELECT coalesce(o.doc_id, n.doc_id)::VARCHAR AS id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.text IS DISTINCT FROM n.text""")
def version_changes(spark, sf_dir):
    """Documents that two stored versions differ in, by their trees of fingerprints."""
    docs, old, new = t(spark, sf_dir, "documents"), scratch_path(spark, "old"), scratch_path(spark, "new")
    versions.write_version(docs.where("doc_id % 17 <> 3"), old, 3, 1)
    versions.write_version(docs.where("doc_id % 23 <> 7").withColumn("text", F.expr("CASE WHEN doc_id % 19 = 4 THEN coalesce(text, '') || ' more' ELSE text END")), new, 3, 1)
    return versions.changes(spark, old, new, 3, 1)


_HITS = "SELECT doc_id AS q_id, rank, (n_chars + rank * 3) % 40 AS page_start, (n_chars + rank * 3) % 40 + rank % 4 AS page_end FROM documents, (SELECT unnest(range(1, 9)) AS rank)"
_RANGES = "SELECT doc_id AS q_id, r AS range, (doc_id * 5 + r * 2) % 40 AS lo, (doc_id * 5 + r * 2) % 40 + 6 AS hi FROM documents, (SELECT unnest(range(0, 4)) AS r)"


@query(f"""WITH RECURSIVE h AS ({_HITS}), g AS ({_RANGES}), m AS MATERIALIZED (SELECT q_id, rank, list(range ORDER BY range) AS met FROM h JOIN g USING (q_id) WHERE page_start <= hi AND page_end >= lo GROUP BY q_id, rank),
f(q_id, rank, used, dcg) AS (SELECT DISTINCT q_id, 0::BIGINT, []::BIGINT[], 0e0 FROM g
UNION ALL SELECT f.q_id, f.rank + 1, CASE WHEN new IS NULL THEN used ELSE list_append(used, new) END, dcg + CASE WHEN new IS NULL THEN 0e0 ELSE 1 / log2(f.rank + 2) END FROM f LEFT JOIN m ON m.q_id = f.q_id AND m.rank = f.rank + 1, LATERAL (SELECT list_filter(coalesce(met, []), lambda x: NOT list_contains(used, x))[1] AS new) WHERE f.rank < 5),
b AS (SELECT q_id, range, min(rank) AS rank FROM (SELECT q_id, rank, unnest(met) AS range FROM m) GROUP BY ALL), p AS (SELECT q_id, min(rank) AS best, count(*) FILTER (rank <= 5) AS covered FROM b GROUP BY q_id)
SELECT f.q_id, coalesce((best <= 5)::INT, 0) AS hit, round(coalesce(covered, 0) / 4, 6) AS recall, round(coalesce(1e0 / best, 0e0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, 5), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM f LEFT JOIN p USING (q_id) WHERE f.rank = 5""")
def overlapping_gold(spark, sf_dir):
    """Metrics where gold ranges overlap and one hit meets several: each hit credits the first range no earlier hit has."""
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("q_id"), "n_chars")
    hits = docs.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(8)))).selectExpr("q_id", "rank", "(n_chars + rank * 3) % 40 AS page_start", "(n_chars + rank * 3) % 40 + rank % 4 AS page_end")
    ranges = docs.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr("q_id", "range", "(q_id * 5 + range * 2) % 40 AS start", "(q_id * 5 + range * 2) % 40 + 6 AS end")
    return evaluation.hit_metrics(hits, ranges, 5)


@query()
def vector_lists(spark, sf_dir):
    """Approximate search of every fiftieth vector: lists looked at, and the recall of the exact best ten, over all vectors."""
    vectors = t(spark, sf_dir, "embeddings")
    asked, centres = vectors.where("vec_id % 50 = 0"), ann.fit_centroids(vectors)
    probes, _ = ann.lists_needed(vectors, asked, centres, 10, 0.95)
    found = ann.search(vectors, asked, centres, 10, probes)
    return ann.recall(found, retrieval.dense(vectors, asked, 10)).select(F.lit(len(centres)).alias("lists"), F.lit(probes).alias("looked_at"), "wanted", "found", "recall")


@query("""SELECT a.vec_id AS q_id, b.vec_id, least(1e0, greatest(-1e0, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6))) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY least(1e0, greatest(-1e0, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6))) DESC, b.vec_id) AS rank FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10""")
def vector_lists_all(spark, sf_dir):
    """The same index with every list looked at: the exact best ten, with clamped scores."""
    vectors = t(spark, sf_dir, "embeddings")
    centres = ann.fit_centroids(vectors)
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), centres, 10, len(centres))


_EIGHT = f"array_to_string({_TOKS.format(c='d.text')}[1:{{n}}], ' ')"


@query(f"""WITH g AS ({ORACLES['rewrite_gate']}), l AS (SELECT conv_id AS item, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
i AS (SELECT item, fires, coalesce(c.text, '') AS message, coalesce({_EIGHT.format(n=8)}, '') AS standalone, CASE WHEN item % 5 = 0 THEN 'clarify' ELSE 'answer' END AS expect,
  CASE WHEN NOT fires THEN 'standalone' WHEN item % 4 IN (1, 3) THEN 'rewrite' WHEN item % 4 = 2 THEN 'clarify' ELSE 'fallback' END AS status, CASE WHEN item % 4 = 1 THEN {_EIGHT.format(n=4)} END AS made, item % 3 = 0 AND item % 4 <> 0 AS named
  FROM l JOIN g ON g.conv_id = item AND g.turn = l.turn JOIN conversations c ON c.conv_id = item AND c.turn = l.turn LEFT JOIN documents d ON d.doc_id = item),
q AS (SELECT item, 'off' AS arm, message AS q FROM i UNION ALL SELECT item, 'on', CASE status WHEN 'clarify' THEN NULL WHEN 'rewrite' THEN coalesce(made, message) ELSE message END FROM i UNION ALL SELECT item, 'oracle', standalone FROM i),
w AS (SELECT DISTINCT q, unnest({_TOKS.format(c='q')}) AS term FROM (SELECT DISTINCT q FROM q WHERE q IS NOT NULL)), x AS (SELECT DISTINCT doc_id, unnest({_TOKS.format(c='text')}) AS term FROM documents),
h AS (SELECT q, doc_id FROM (SELECT q, doc_id, count(*) AS n FROM w JOIN x USING (term) GROUP BY q, doc_id) QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, doc_id) <= 5),
s AS (SELECT item, max((h.q IS NOT NULL)::INT) FILTER (arm = 'off') AS a, max((h.q IS NOT NULL)::INT) FILTER (arm = 'on') AS b, max((h.q IS NOT NULL)::INT) FILTER (arm = 'oracle') AS c FROM q LEFT JOIN h ON h.q = q.q AND h.doc_id = q.item GROUP BY item),
r AS (SELECT *, expect = 'answer' AS ans FROM i JOIN s USING (item)), z AS (SELECT count(*) AS items, count(*) FILTER (ans) AS n, coalesce(sum(a) FILTER (ans), 0) AS a, coalesce(sum(b) FILTER (ans), 0) AS b, coalesce(sum(c) FILTER (ans), 0) AS c, count(*) FILTER (ans AND b > a) AS wins, count(*) FILTER (ans AND b < a) AS losses,
  count(*) FILTER (fires) AS gate_calls, count(*) FILTER (fires AND status = 'fallback') AS fallbacks, count(*) FILTER (ans AND status = 'clarify') AS false_clarify, count(*) FILTER (NOT ans) AS clarify_n, count(*) FILTER (NOT ans AND status = 'clarify') AS clarify_asked, count(*) FILTER (NOT ans AND status = 'clarify' AND named) AS clarify_named FROM r)
SELECT items, n, round(a / greatest(n, 1), 3) AS hit_off, round(b / greatest(n, 1), 3) AS hit_on, round(c / greatest(n, 1), 3) AS hit_oracle, wins, n - wins - losses AS ties, losses, CASE WHEN c > a THEN round((b - a) / (c - a), 3) END AS gap_closed, gate_calls, fallbacks, false_clarify, clarify_n, clarify_asked, clarify_named FROM z""")
def arms_summary(spark, sf_dir):
    """The last question of every conversation asked raw, rewritten and standalone: one search for all arms, one summary row."""
    turns, docs = t(spark, sf_dir, "conversations"), t(spark, sf_dir, "documents")
    users = conversations.pairs(turns)
    last = users.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = users.join(last, "conv_id")
    earlier = rows.where("turn < last").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("h"))
    history = F.transform("h", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer")))
    words = docs.select(F.col("doc_id").alias("conv_id"), F.slice(tx.tokens(F.col("text")), 1, 8).alias("ts"))  # cut before the join, so texts aren't shuffled
    items = rows.where("turn = last").join(earlier, "conv_id", "left").join(words, "conv_id", "left")
    first = lambda n: F.array_join(F.slice("ts", 1, n), " ")
    made = stored(items.select(F.col("conv_id").alias("item"), F.when(F.col("conv_id") % 5 == 0, "clarify").otherwise("answer").alias("expect"), F.col("question").alias("message"), first(8).alias("standalone"), history.alias("history"), first(4).alias("four")), "items")
    kind = F.when(F.col("item") % 4 == 2, "clarify").otherwise("rewrite")
    replies = made.where("item % 4 <> 0").select("item", kind.alias("status"), F.when(F.col("item") % 4 == 1, F.col("four")).alias("question"), (F.col("item") % 3 == 0).alias("named"))

    return arms.run(made.drop("four"), replies, docs.select(F.col("doc_id").alias("item"), "doc_id"), lambda questions: overlap.most_shared(docs, questions, 5))
