"""Registered queries over pages and chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _CHUNKS, _TOKS, _WORDS, query
from .functions import text as tx
from .jobs import evaluate
from .operators import chunking, pages, retrieval
from .sources.tables import table as t

_STARTS = r"""p AS MATERIALIZED (SELECT source, doc_id, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]'))"""


def _running(spark, sf_dir: str):
    docs = t(spark, sf_dir, "documents").where(pages.not_blank(F.col("text"))).select("source", "doc_id", "text")
    return docs, pages.page_ranges(chunking.page_starts(docs, "source"), docs, "source")


@query(f'WITH {_STARTS} SELECT source, doc_id, start, start + length(text) AS "end" FROM p')
def page_text_range(spark, sf_dir):
    """Where each page lies in its source's running text; blank pages aren't in it."""
    return _running(spark, sf_dir)[1]


@query(f"""WITH {_STARTS}, e AS (SELECT source, max(start + length(text)) AS total FROM p GROUP BY source), c AS (SELECT source, unnest(range(0, total, 3200))::BIGINT AS start, total FROM e),
s AS (SELECT source, start, least(start + 4000, total)::BIGINT AS "end" FROM c), a AS (SELECT s.*, p.doc_id AS page_start FROM s ASOF JOIN p ON s.source = p.source AND s.start >= p.start)
SELECT a.source, a.start, a."end", page_start, p.doc_id AS page_end FROM (SELECT *, greatest("end" - 1, start) AS last FROM a) a ASOF JOIN p ON a.source = p.source AND a.last >= p.start""")
def page_of_offset(spark, sf_dir):
    """Windows of 4,000 characters over each source's running text, with their first and last page."""
    docs, ranges = _running(spark, sf_dir)
    totals = ranges.groupBy("source").agg(F.max("end").alias("total"))
    spans = totals.select("source", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(3200).cast("long"))).alias("start"))
    return pages.page_of(spans.select("source", "start", F.least(F.col("start") + 4000, "total").cast("long").alias("end")), ranges, "source")


_KEY = r"trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), k AS (SELECT *, {_KEY} AS key FROM l),
r AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= (SELECT greatest(2, floor(count(*) * 0.02e0)) FROM documents)),
g AS (SELECT *, key IN (SELECT key FROM r) OR (regexp_matches(line, '(?s)^\s*\d+\s*\|\s*\S.*$|^.*\S\s*\|\s*\d+\s*$') AND length(line) < 120) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id""")
def running_headers(spark, sf_dir):
    """Documents without lines that many of them repeat."""
    return pages.without_running_lines(t(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), c AS (SELECT *, contains(line, ' | ') AS is_code FROM l),
s AS (SELECT *, CASE WHEN is_code AND coalesce(lag(is_code) OVER (PARTITION BY doc_id ORDER BY pos), false) THEN 0 ELSE 1 END AS fresh FROM c),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM s)
SELECT doc_id, block::BIGINT AS block, any_value(is_code) AS is_code, count(*) AS n, sha256(CASE WHEN any_value(is_code) THEN '```' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) || '```' ELSE string_agg(line, chr(10) ORDER BY pos) END) AS text_sha256 FROM b GROUP BY doc_id, block""")
def code_blocks(spark, sf_dir):
    """Lines of documents, those of tables as code, each run of them one fenced block."""
    lines = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    made = pages.merged_code(lines.withColumn("is_code", F.contains("text", F.lit(" | "))))
    return made.select("doc_id", "block", "is_code", "n", F.sha2("text", 256).alias("text_sha256"))


_TITLE = "CASE WHEN doc_id % 23 = 5 THEN 'Part I. Foundations' WHEN doc_id % 29 = 28 THEN 'Index' ELSE lang END"


@query(f"""WITH b AS (SELECT source, min(doc_id) FILTER (starts_with(title, 'Part I.')) AS first, min(doc_id) FILTER (title IN ('Glossary', 'Index')) - 1 AS last FROM (SELECT source, doc_id, {_TITLE} AS title FROM documents) GROUP BY source)
SELECT source, CASE WHEN first <= last THEN first END AS first, CASE WHEN first <= last THEN last END AS last FROM b""")
def body_range(spark, sf_dir):
    """The body pages of each source, by titles that some of its pages have."""
    return pages.body_ranges(t(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.expr(_TITLE).alias("title")), "source")


_OPENED = "CASE WHEN doc_id % 17 = 9 THEN 'Introduction' || chr(10) || text WHEN doc_id % 13 = 4 THEN 'Contents' || chr(10) || 'Preface' ELSE text END"


@query(rf"""WITH d AS (SELECT source, doc_id, {_OPENED} AS text FROM documents WHERE source IS NOT NULL), n AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM d WHERE regexp_matches(text, '[^\x20\x09-\x0D]') QUALIFY nth <= 40),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY NOT opens, nth) AS best FROM (SELECT *, regexp_matches(substring(text, 1, 400), '{tx.re2(pages.OPENING)}') AND NOT regexp_matches(text, '{tx.re2(pages.CONTENTS)}') AS opens FROM e) WHERE opens OR nth = 2 QUALIFY best = 1)
SELECT source, pages, sha256(substring(f.text, 1, 600)) AS title_sha256, o.doc_id AS opening_page, sha256(substring(o.text, 1, 3000)) AS opening_sha256 FROM n LEFT JOIN (SELECT source, text FROM e WHERE nth = 1) f USING (source) LEFT JOIN o USING (source)""")
def document_profile(spark, sf_dir):
    """Title page and opening of each source, some of whose pages have headings planted."""
    docs = t(spark, sf_dir, "documents").select("source", "doc_id", F.expr(_OPENED.replace("chr(10)", "char(10)")).alias("text"))
    made = pages.profiles(docs, "source")
    return made.select("source", "pages", F.sha2("title_page", 256).alias("title_sha256"), "opening_page", F.sha2("opening", 256).alias("opening_sha256"))


@query(f"""WITH {_CHUNKS} SELECT source || ':' || doc_id || ':fixed-' || lpad(chunk::VARCHAR, 5, '0') AS chunk_id, sha256(source || ' > ' || lang || chr(10) || k.text) AS variant_sha256 FROM k JOIN documents USING (doc_id)""")
def chunk_variants(spark, sf_dir):
    """Qualified ids of chunks, and their texts under the path of what they are part of, as an index stores them."""
    docs = t(spark, sf_dir, "documents")
    rows = chunking.fixed_chunks(docs).join(docs.select("doc_id", "source", "lang"), "doc_id")
    name = F.concat("source", F.lit(":"), "doc_id", F.lit(":fixed-"), F.lpad(F.col("chunk").cast("string"), 5, "0"))
    return rows.select(name.alias("chunk_id"), F.sha2(F.concat("source", F.lit(" > "), "lang", F.lit("\n"), "text"), 256).alias("variant_sha256"))


@query(f"""WITH d AS (SELECT source, len({_TOKS.format(c="text")}) AS n FROM documents) SELECT source, round(100 * avg((n > 256)::INT), 1) AS truncated_pct, floor(quantile_cont(n, 0.5))::BIGINT AS tokens_median FROM d GROUP BY source""")
def token_stats(spark, sf_dir):
    """How many of a source's documents a model of 256 tokens would cut, and their median length."""
    rows = t(spark, sf_dir, "documents").select("source", F.size(tx.tokens(F.col("text"))).alias("n"))
    return rows.groupBy("source").agg(F.round(100 * F.avg((F.col("n") > 256).cast("double")), 1).alias("truncated_pct"), F.floor(F.percentile("n", F.lit(0.5))).cast("long").alias("tokens_median"))


@query("SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) = count(DISTINCT doc_id) AS is_unique FROM documents GROUP BY source")
def distinct_ids(spark, sf_dir):
    counts = t(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"))
    return counts.withColumn("is_unique", F.col("n") == F.col("ids"))


_CRC = "list_reduce([4294967295::UBIGINT] || list_transform(range(0, octet_length(encode(w))), lambda i: ascii(w[i + 1])::UBIGINT), lambda c, b: list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END))"


@query(f"""WITH w AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), k AS MATERIALIZED (SELECT w, (xor({_CRC}, 4294967295::UBIGINT) % 256)::INT AS bucket FROM (SELECT DISTINCT w FROM w))
SELECT doc_id, bucket, count(*) AS n FROM w JOIN k USING (w) GROUP BY ALL""")
def hash_counts(spark, sf_dir):
    """The word counts that a document's hashed vector is made of."""
    return retrieval.hashed_counts(t(spark, sf_dir, "documents"))


_EVIDENCE = f"e AS (SELECT item_id AS q_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '{tx.TOKEN}'), lambda w: length(w) >= 9))) AS term FROM benchmark)"


@query(rf"""WITH g AS MATERIALIZED (SELECT item_id AS q_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), {_CHUNKS}, {_EVIDENCE},
n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')) AS page FROM documents WHERE doc_id IN (SELECT doc_id FROM g)),
w AS (SELECT q_id, doc_id, list(term) AS terms FROM g JOIN e USING (q_id) JOIN n USING (doc_id) WHERE contains(page, term) GROUP BY ALL),
o AS (SELECT q_id, doc_id, max((len(list_filter(terms, lambda x: NOT contains(lower(k.text), x))) = 0)::INT) AS ok FROM w JOIN k USING (doc_id) GROUP BY ALL)
SELECT q_id, count(*) AS checked, min(ok) = 1 AS intact FROM o GROUP BY q_id""")
def evidence_ranges(spark, sf_dir):
    """Whether one chunk has all evidence words (nine letters or more) that a gold page has, for every gold page."""
    docs, bench = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    gold = evaluate.gold(docs, bench).select("q_id", F.col("doc_id").alias("range"), F.col("doc_id").alias("start"), F.col("doc_id").alias("end"))
    terms = bench.select(F.col("item_id").alias("q_id"), F.explode(F.array_distinct(tx.tokens(F.col("text"), drop_stopwords=False))).alias("term")).where("length(term) >= 9")
    chunks = chunking.fixed_chunks(docs).select(F.col("doc_id").alias("start"), F.col("doc_id").alias("end"), "text")
    return pages.intact_ranges(gold, terms, docs, chunks)


_MARKED = rf"""w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(c="text")} AS w FROM documents),
f AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: i = 1 OR (regexp_matches(w[i - 1], '[.!?]["”’)\]]*$') AND regexp_matches(w[i], '^[A-Z“"(\[]'))) AS heads FROM w),
s AS MATERIALIZED (SELECT doc_id, w, CASE WHEN len(w) <= 200 THEN CASE WHEN len(w) = 0 THEN [] ELSE [1] END ELSE flatten(list_transform(range(1, len(heads) + 1), lambda k: range(heads[k], CASE WHEN k = len(heads) THEN len(w) + 1 ELSE heads[k + 1] END, 200))) END AS heads FROM f)"""


@query(rf"""WITH {_MARKED} SELECT doc_id, unnest(range(0, len(heads)))::INT AS unit, unnest(list_transform(range(1, len(heads) + 1), lambda k: CASE WHEN k = len(heads) THEN len(w) + 1 ELSE heads[k + 1] END - heads[k]))::INT AS n_words FROM s""")
def sentence_words(spark, sf_dir):
    """Words of the units that chunks are packed of. The tables have neither blank lines nor code: one paragraph each."""
    return chunking.sentence_units(t(spark, sf_dir, "documents")).select("doc_id", "unit", "n_words")


@query(rf"""WITH RECURSIVE {_MARKED}, c AS MATERIALIZED (SELECT doc_id, w, list_append(heads, len(w) + 1) AS e FROM s WHERE len(heads) > 0),
r(doc_id, chunk, i, j) AS (SELECT doc_id, 0, 1, greatest(2, len(list_filter(e, lambda x: x - e[1] <= 200))) FROM c UNION ALL
SELECT doc_id, chunk + 1, b, greatest(b + 1, len(list_filter(e, lambda x: x - e[b] <= 200))) FROM (SELECT r.doc_id, chunk, e, greatest(i + 1, 1 + len(list_filter(e, lambda x: x < e[j] - 40))) AS b FROM r JOIN c USING (doc_id) WHERE j < len(e)))
SELECT doc_id, chunk, sha256(array_to_string(w[e[i]:e[j] - 1], ' ')) AS words_sha256 FROM r JOIN c USING (doc_id)""")
def packed_words(spark, sf_dir):
    """The words of recursive chunks: sentences packed to 200 words, 40 again."""
    made = chunking.recursive_chunks(t(spark, sf_dir, "documents"))
    return made.select("doc_id", "chunk", F.sha2(F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " "), 256).alias("words_sha256"))


@query()
def semantic_chunks(spark, sf_dir):
    return chunking.semantic_chunks(t(spark, sf_dir, "documents"))
