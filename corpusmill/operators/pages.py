"""Pages of running texts: places of offsets, running headers, merged code, body ranges, exports, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Characters in one bucket of a running text: what offsets and pages meet on.
BUCKET = 8_192
SEPARATOR = "\n\n"


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def page_ranges(starts: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """starts(by, doc_id, start), pages(by, doc_id, text) -> (by, doc_id, start, end): where each page lies; end is exclusive."""
    sizes = pages.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("__n"))
    return starts.join(sizes, "doc_id").select(by, "doc_id", "start", (F.col("start") + F.col("__n")).cast("long").alias("end"))


def _page_at(spans: DataFrame, ranges: DataFrame, by: str, offset: str, name: str) -> DataFrame:
    """The page that holds an offset, or the last one before it: an equi-join on buckets of the running text."""
    first, last = F.col("start"), F.greatest(F.col("start"), F.col("end") + len(SEPARATOR) - 1)
    parts = ranges.select(F.col(by).alias("__by"), F.col("doc_id").alias(name), first.alias("__a"), last.alias("__b"), F.explode(F.sequence(F.floor(first / BUCKET), F.floor(last / BUCKET))).alias("__bucket"))
    inside = (F.col(by).eqNullSafe(F.col("__by"))) & (F.floor(F.col(offset) / BUCKET) == F.col("__bucket")) & F.col(offset).between(F.col("__a"), F.col("__b"))
    return spans.join(parts, inside, "left").drop("__by", "__a", "__b", "__bucket")


def page_of(spans: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    """spans(by, start, end) of a running text with page_start and page_end: the pages of their first and last character.

    The two characters that join pages belong to the page before them. A text of any length, and a group that holds most
    pages, is spread over buckets of BUCKET characters. Offsets outside the text have no page.
    """
    out = _page_at(spans.withColumn("__last", F.greatest(F.col("end") - 1, F.col("start"))), ranges, by, "start", "page_start")
    return _page_at(out, ranges, by, "__last", "page_end").drop("__last")


def without_running_lines(docs: DataFrame, share: float = 0.02) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): documents without the lines whose key stands in at least max(2, share of all)
    documents, and without running footers. Null texts have no lines. A repeated key stands in a share of all documents, so
    there are few of them."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", tx.repeat_key(F.col("line")))
    seen = lines.where("key <> ''").groupBy("key").agg(F.count_distinct("doc_id").alias("n"))
    least = docs.agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * F.lit(share))).alias("least"))
    repeated = seen.crossJoin(F.broadcast(least)).where("n >= least").select("key", F.lit(True).alias("again"))  # `least` is one row
    gone = F.coalesce("again", F.lit(False)) | F.coalesce(tx.is_running_footer(F.col("line")), F.lit(False))
    marked = lines.join(repeated, "key", "left").select("doc_id", "pos", "line", gone.alias("gone"))
    kept = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("pos", "line"))))  # one document's lines
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("gone").alias("n_removed"), F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"))


def merged_code(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, pos, text, is_code) with each run of code blocks as one fenced block: (doc_id, block, is_code, n, text)."""
    order = Window.partitionBy("doc_id").orderBy("pos")  # one page's blocks
    starts = ~F.col("is_code") | ~F.coalesce(F.lag("is_code").over(order), F.lit(False))
    runs = blocks.withColumn("__new", starts.cast("int")).withColumn("block", F.sum("__new").over(order))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    out = runs.groupBy("doc_id", "block").agg(F.first("is_code").alias("is_code"), F.count(F.lit(1)).alias("n"), lines.alias("text"))
    return out.withColumn("text", F.when(F.col("is_code"), F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text")))


def body_ranges(toc: DataFrame, by: str) -> DataFrame:
    """toc(by, page, title) -> (by, first, last): from the page of the first title "Part I." to the one before the first Glossary or
    Index; nulls (keep every page) unless both are there in that order."""
    at = toc.groupBy(by).agg(F.min(F.when(F.col("title").startswith("Part I."), F.col("page"))).alias("first"), (F.min(F.when(F.col("title").isin("Glossary", "Index"), F.col("page"))) - 1).alias("last"))
    both = F.col("first") <= F.col("last")
    return at.select(by, F.when(both, F.col("first")).alias("first"), F.when(both, F.col("last")).alias("last"))


#: Headings of a text that says what it is for, and of a list of contents.
OPENING = r"(?im)^\s*(preface|foreword|introduction|who (?:this|the) (?:book|guide) is for|audience|about this (?:book|guide))\b"
CONTENTS = r"(?i)^\s*(table of )?contents\b"


def profiles(pages: DataFrame, by: str, title_chars: int = 600, search: int = 40, opening_chars: int = 3000) -> DataFrame:
    """pages(by, doc_id, text) -> (by, pages, title_page, opening_page, opening): what a document shows of itself.

    The title page is the first with text; the opening is the first of its first `search` pages whose beginning has an
    opening heading and that is no list of contents, else the second page with text.
    """
    rows = pages.where(F.col(by).isNotNull())
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("pages"))
    order = Window.partitionBy(by).orderBy("doc_id")
    early = rows.where(not_blank(F.col("text"))).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= search)
    opens = F.substring("text", 1, 400).rlike(OPENING) & ~F.col("text").rlike(CONTENTS)
    named = F.min(F.when(opens, F.struct("nth", "doc_id", "text")))
    second = F.min(F.when(F.col("nth") == 2, F.struct("nth", "doc_id", "text")))
    found = early.groupBy(by).agg(F.min_by("text", "nth").alias("title"), F.coalesce(named, second).alias("o"))
    return counts.join(found, by, "left").select(by, "pages", F.substring("title", 1, title_chars).alias("title_page"), F.col("o.doc_id").alias("opening_page"), F.substring("o.text", 1, opening_chars).alias("opening"))


def intact_ranges(gold: DataFrame, terms: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """gold(q_id, range, start, end), terms(q_id, term), pages(doc_id, text), chunks(start, end, text) -> (q_id, checked, intact).

    Of each range the terms that stand on its pages must stand together in one chunk that overlaps it; a range without
    terms isn't checked. Case and white space are aside.
    """
    plain = lambda c: tx.plain_quotes(F.coalesce(c, F.lit("")))
    spans = gold.withColumn("doc_id", F.explode(F.sequence("start", "end")))
    there = spans.join(pages.select("doc_id", plain(F.col("text")).alias("__page")), "doc_id").join(terms.select("q_id", plain(F.col("term")).alias("__term")), "q_id").where(F.contains("__page", "__term"))
    wanted = there.groupBy("q_id", "range", "start", "end").agg(F.collect_set("__term").alias("__terms"))
    cut = chunks.select(F.explode(F.sequence("start", "end")).alias("doc_id"), plain(F.col("text")).alias("__chunk"))
    holds = wanted.withColumn("doc_id", F.explode(F.sequence("start", "end"))).join(cut, "doc_id", "left")
    each = holds.groupBy("q_id", "range").agg(F.max(F.coalesce(F.forall("__terms", lambda x: F.contains(F.col("__chunk"), x)), F.lit(False))).alias("ok"))
    return each.groupBy("q_id").agg(F.count(F.lit(1)).alias("checked"), F.min("ok").alias("intact"))
