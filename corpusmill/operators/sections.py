"""Sections of documents by a table of titles, parents made of sections, and children inside parents.

A document's titles are looked for in their order, each from the place where the last was found on the same page, as a line of its
own; the search, the path of titles above a section and the merging of short sections are folds over a document's own titles or
sections, inside Spark expressions, so documents are the unit of work and nothing is sorted or shuffled but the titles.

Defined results: null text is empty and has no sections; a title on a page the document doesn't have (null page_start) is left out; a null or blank
title stands where its page begins; a document without titles is one section named (start of body).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .chunking import _spans_of

#: What may stand before a title in a table of titles and in the text, and the name of what stands before the first one.
PREFIX, OPENER, BODY = r"^(?:Chapter|Part)\s+[\dIVX]+\.\s*", r"(?:(?:chapter|part)\s+[\dIVX]+\s+)?", "(start of body)"
_MARK = "array<struct<start:bigint,level:bigint,path:array<string>>>"
_SECTION = "array<struct<start:bigint,end:bigint,level:bigint,path:array<string>,words:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def title_pattern(title: Column) -> Column:
    """A pattern for the title as a line of its own: case, white space and the kind of apostrophe don't matter."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), PREFIX, ""), "’", "'"), r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.replace(F.regexp_replace(w, r"([^\w\s])", r"\\$1"), F.lit(r"\'"), F.lit("['’]")))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?mid)^\s*" + OPENER), F.array_join(plain, r"\s+"), F.lit(r"\s*$")))


def _found(text: Column, entry: Column, begin: Column) -> Column:
    """Where the entry's title begins in text[begin:page_end], or null. A mark in front keeps the cut from looking like a line's begin."""
    inside = (begin > 0) & (F.substring(text, begin.cast("int"), F.lit(1)) != "\n")
    part = F.concat(F.when(inside, F.lit("\u0001")).otherwise(""), F.substring(text, (begin + 1).cast("int"), F.greatest(entry["page_end"] - begin, F.lit(0)).cast("int")))

    def place(sub: Column) -> Column:
        at, match = F.regexp_instr(sub, entry["pattern"]), F.regexp_substr(sub, entry["pattern"])
        lead = F.length(match) - F.length(F.regexp_replace(match, r"^\s+", ""))
        return F.when(at > 0, begin - F.when(inside, 1).otherwise(0) + at - 1 + lead)

    return _let(part, place)


def with_marks(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """docs(doc_id, text) with marks: where each of toc(doc_id, ord, page, page_start, page_end, level, title) begins, and the path to it.

    A title that isn't found stands where its page begins, unless the last one is on that page too: then it is left out.
    """
    entry = F.struct("ord", F.col("page").cast("long").alias("page"), F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), F.col("level").cast("long").alias("level"), F.coalesce("title", F.lit("")).alias("title"), title_pattern(F.col("title")).alias("pattern"))
    entries = toc.where("page_start IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("__entries"))  # a document's own titles
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("page"), F.array().cast("array<struct<level:bigint,title:string>>").alias("stack"), F.array().cast(_MARK).alias("marks"))

    def step(acc: Column, e: Column) -> Column:
        again = F.coalesce(e["page"] == acc["page"], F.lit(False))
        begin = F.when(again, F.greatest(e["page_start"], acc["at"] + 1)).otherwise(e["page_start"])

        def placed(at: Column) -> Column:
            def added(stack: Column) -> Column:
                mark = F.struct(at.alias("start"), e["level"].alias("level"), F.transform(stack, lambda s: s["title"]).alias("path"))
                return F.struct(at.alias("at"), e["page"].alias("page"), stack.alias("stack"), F.concat(acc["marks"], F.array(mark)).alias("marks"))

            above = F.filter(acc["stack"], lambda s: s["level"] < e["level"])
            return F.when(at.isNull(), acc).otherwise(_let(F.concat(above, F.array(F.struct(e["level"].alias("level"), e["title"].alias("title")))), added))

        return _let(F.coalesce(_let(begin, lambda b: _found(F.col("text"), e, b)), F.when(~again, e["page_start"])), placed)

    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).join(entries, "doc_id", "left")
    marks = F.aggregate(F.coalesce("__entries", F.array().cast(entries.schema["__entries"].dataType)), start, step)["marks"]
    return rows.withColumn("marks", marks).drop("__entries")


def with_sections(marked: DataFrame) -> DataFrame:
    """`with_marks` rows with sections in reading order: (start, end, level, path, words), each up to the next; empty ones are left out."""
    body = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("level"), F.array(F.lit(BODY)).alias("path")))
    marks = F.when(F.coalesce(F.get("marks", F.lit(0))["start"] > 0, F.lit(True)), F.concat(body, "marks")).otherwise(F.col("marks"))
    end = lambda all_, i: F.coalesce(F.get(all_, i + 1)["start"], F.length("text").cast("long"))
    spans = _let(marks, lambda all_: F.transform(all_, lambda m, i: _section(m["start"], end(all_, i), m["level"], m["path"])))
    return marked.withColumn("sections", F.filter(spans, lambda s: s["end"] > s["start"]).cast(_SECTION)).drop("marks")


def _section(start: Column, end: Column, level: Column, path: Column) -> Column:
    words = tx.word_count(F.substring(F.col("text"), (start + 1).cast("int"), (end - start).cast("int"))).cast("long")
    return F.struct(start.alias("start"), end.alias("end"), level.alias("level"), path.alias("path"), words.alias("words"))


def merged(sectioned: DataFrame, least: int = 60, top_level: int = 2) -> DataFrame:
    """`with_sections` rows whose sections under `least` words are joined to the next, but never to one of top_level or above; the
    joined section has the later one's level and path."""

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = (F.size(done) > 0) & (last["words"] < least) & (s["level"] > top_level)
        both = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(_section(last["start"], s["end"], s["level"], s["path"])))
        return F.when(F.coalesce(joins, F.lit(False)), both).otherwise(F.concat(done, F.array(s))).cast(_SECTION)

    return sectioned.withColumn("sections", F.aggregate("sections", F.array().cast(_SECTION), step))


def parents_and_children(docs: DataFrame, toc: DataFrame, least: int = 120, most: int = 600, child: int = 100, overlap: int = 20, code_max: int = 400) -> DataFrame:
    """(doc_id, parent, section, parent_start, parent_end, chunk, start, end, text): parents are merged sections, cut at paragraphs and
    sentences where they have over `most` words; children of about `child` words lie inside one parent. Children are numbered
    through the document."""
    rows = merged(with_sections(with_marks(docs.select("doc_id", "text"), toc)), least).select("doc_id", "text", F.transform("sections", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array_join(s["path"], " > ").alias("path"))).alias("sections"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, text, sections in zip(f["doc_id"], f["text"], f["sections"], strict=True):
                parent = chunk = 0
                for s in sections:
                    whole = text[s["start"] : s["end"]]
                    cuts = [(0, len(whole))] if len(whole.split()) <= most else _spans_of(whole, most, 0, code_max)
                    for lo, hi in cuts:
                        begin = s["start"] + lo
                        for a, b in _spans_of(whole[lo:hi], child, overlap, code_max):
                            out.append((doc, parent, s["path"], begin, s["start"] + hi, chunk, begin + a, begin + b, text[begin + a : begin + b]))
                            chunk += 1
                        parent += 1
            yield pd.DataFrame(out, columns=["doc_id", "parent", "section", "parent_start", "parent_end", "chunk", "start", "end", "text"])

    return rows.mapInPandas(run, "doc_id long, parent int, section string, parent_start long, parent_end long, chunk int, start long, end long, text string")
