"""Cutting documents into chunks: fixed windows, sentences, packed sentences, places in pages, chunk statistics."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

_FENCE = re.compile(r"^```\n.*?\n```$", re.DOTALL | re.MULTILINE)
#: What may stand between a sentence's last mark and the space, and what a sentence may begin with besides A to Z.
_CLOSERS, _OPENERS = '"”’)]', '“"(['


def fixed_chunks(docs: DataFrame, size: int = 200, overlap: int = 40) -> DataFrame:
    """Windows of `size` words, each sharing `overlap` words with the one before: (doc_id, chunk, n_words, text)."""
    step = size - overlap
    words = docs.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    count = F.when(F.size("w") <= size, F.lit(1)).otherwise(1 + F.ceil((F.size("w") - size) / step).cast("int"))
    parts = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    piece = F.slice("w", F.col("chunk") * step + 1, size)
    return parts.select("doc_id", "chunk", F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("text"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: how long chunks are, and how many begin or end inside a sentence."""
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 1)
    return chunks.agg(
        F.count(F.lit(1)).alias("n"), *(F.floor(F.percentile("n_words", F.lit(p))).cast("long").alias(n) for p, n in ((0.1, "words_p10"), (0.5, "words_median"), (0.9, "words_p90"))), F.max("n_words").alias("words_max"),
        share(F.col("text").rlike("^[a-z]")).alias("mid_sentence_start_pct"), share(~F.col("text").rlike("[.!?]$")).alias("mid_sentence_end_pct"),
    )


def marked_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (start, end) of the words of a text; how strong a border stands before each: 3 an edge of fenced code, 2 a
    blank line, 1 a sentence or a line of code, 0 none; and which words are fenced code."""
    spans = np.array([m.span() for m in re.finditer(r"\S+", text)], np.int64).reshape(-1, 2)
    starts, n = spans[:, 0], len(spans)
    level, fenced = np.zeros(n, np.int8), np.zeros(n, bool)
    if not n:
        return spans, level, fenced
    found = [text[a:b] for a, b in spans.tolist()]
    ends = np.array([w.rstrip(_CLOSERS)[-1:] in (".", "!", "?") for w in found])
    opens = np.array(["A" <= w[0] <= "Z" or w[0] in _OPENERS for w in found])
    level[1:] = ends[:-1] & opens[1:]
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
    lines = np.diff(np.searchsorted(breaks, starts), prepend=0)  # how many lines begin between two words
    level[lines >= 2] = 2
    for fence in _FENCE.finditer(text):
        lo, hi = np.searchsorted(starts, fence.span())
        level[lo:hi], fenced[lo:hi] = lines[lo:hi] > 0, True
        level[lo : lo + 1], level[hi : hi + 1] = 3, 3
    return spans, level, fenced


def _cut(at: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """lo to hi in parts that begin where a flag is set."""
    edges = [lo, *(np.flatnonzero(at[lo + 1 : hi]) + lo + 1).tolist(), hi]
    return list(zip(edges, edges[1:], strict=False))


def unit_words(level: np.ndarray, fenced: np.ndarray, size: int, code_max: int) -> list[tuple[int, int]]:
    """Runs of words that shouldn't be cut: paragraphs of at most `size` words, else their sentences, else groups of words;
    fenced code of at most `code_max` words, else its lines."""
    out: list[tuple[int, int]] = []
    for lo, hi in _cut(level >= 2, 0, len(level)) if len(level) else ():
        if hi - lo <= (code_max if fenced[lo] else size):
            out.append((lo, hi))
            continue
        for a, b in _cut(level >= 1, lo, hi):
            step = b - a if fenced[lo] else size
            out += [(k, min(k + step, b)) for k in range(a, b, step)]
    return out


def pack_units(sizes: list[int] | np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Runs (first unit, last unit + 1) of at most `size` words, found on the running total of words; up to `overlap` words
    come again in the next run; a larger unit stands alone."""
    total = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    runs, at = [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        runs.append((at, to))
        at = len(sizes) if to == len(sizes) else max(at + 1, int(np.searchsorted(total, total[to] - overlap)))
    return runs


def _spans_of(text: str, size: int, overlap: int, code_max: int) -> list[tuple[int, int]]:
    """Places of the packed chunks of a text."""
    spans, level, fenced = marked_words(text)
    units = unit_words(level, fenced, size, code_max)
    runs = pack_units([b - a for a, b in units], size, overlap)
    return [(int(spans[units[i][0], 0]), int(spans[units[j - 1][1] - 1, 1])) for i, j in runs]


def recursive_chunks(docs: DataFrame, size: int = 200, overlap: int = 40, code_max: int = 400) -> DataFrame:
    """Chunks that respect paragraphs, sentences and fenced code: (doc_id, chunk, start, end, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                rows += [(d, i, a, b, t[a:b]) for i, (a, b) in enumerate(_spans_of(t or "", size, overlap, code_max))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, start int, end int, text string")


def sentence_units(docs: DataFrame, size: int = 200, code_max: int = 400) -> DataFrame:
    """The units that chunks are packed of: (doc_id, unit, start, end, n_words). Null and blank texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                spans, level, fenced = marked_words(t or "")
                rows += [(d, i, spans[a, 0], spans[b - 1, 1], b - a) for i, (a, b) in enumerate(unit_words(level, fenced, size, code_max))]
            yield pd.DataFrame(rows, columns=["doc_id", "unit", "start", "end", "n_words"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, unit int, start int, end int, n_words int")


_HIDDEN = re.compile(r"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", re.IGNORECASE | re.DOTALL)
_HEADING = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", re.IGNORECASE | re.DOTALL)
_BLOCK_TAG = re.compile(r"</?(?:p|div|li|ul|ol|tr|table|section|article|header|footer|nav|br|body|html)\b[^>]*>", re.IGNORECASE)


def _plain(markup: str) -> str:
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in _BLOCK_TAG.split(markup))
    return "\n\n".join(line for line in lines if line)


def _sections(markup: str) -> list[tuple[int, str, str]]:
    """(level, path of titles, text) for what stands before the first heading (level 0) and under each one."""
    parts = _HEADING.split(_HIDDEN.sub(" ", markup))
    out, titles = [(0, "", _plain(parts[0]))], {}
    for level, title, body in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
        titles = {k: v for k, v in titles.items() if k < int(level)} | {int(level): _plain(title)}
        out.append((int(level), " > ".join(titles[k] for k in sorted(titles)), _plain(body)))
    return out


def heading_chunks(pages: DataFrame, most: int = 300, stub: int = 60) -> DataFrame:
    """Chunks of web pages along their headings: (page_id, chunk, section, n_words, text).

    A section under `stub` words joins the next one, but never one of level 1 or 2; one over `most` words is cut at
    paragraphs and sentences. Null pages have none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page, markup in zip(f["page_id"], f["html"], strict=True):
                merged: list[tuple[int, str, str]] = []
                for level, path, body in _sections(markup or ""):
                    if merged and level > 2 and len(merged[-1][2].split()) < stub:
                        first = merged.pop()
                        level, path, body = first[0], first[1] or path, f"{first[2]}\n\n{body}".strip()
                    merged.append((level, path, body))
                cuts = [(path, body[a:b]) for _, path, body in merged for a, b in _spans_of(body, most, 0, most)]
                rows += [(page, i, path, len(text.split()), text) for i, (path, text) in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=["page_id", "chunk", "section", "n_words", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, chunk int, section string, n_words int, text string")


def parent_child_chunks(docs: DataFrame, parent_size: int = 600, child_size: int = 100, overlap: int = 20, code_max: int = 400) -> DataFrame:
    """Small chunks for search inside large ones for reading: (doc_id, parent, chunk, start, end, parent_start, parent_end, text).

    Places count from the start of the document; a child never leaves its parent.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                for p, (lo, hi) in enumerate(_spans_of(t or "", parent_size, 0, code_max)):
                    rows += [(d, p, i, lo + a, lo + b, lo, hi, t[lo + a : lo + b]) for i, (a, b) in enumerate(_spans_of(t[lo:hi], child_size, overlap, code_max))]
            yield pd.DataFrame(rows, columns=["doc_id", "parent", "chunk", "start", "end", "parent_start", "parent_end", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, parent int, chunk int, start int, end int, parent_start int, parent_end int, text string")


#: Buckets of the hashing embedder.
DIMENSIONS = 256


def hashed_vectors(texts: list[str], dim: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of word counts by crc32 bucket; a text without words is the zero vector."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        np.add.at(out[i], [zlib.crc32(w.encode()) % dim for w in re.findall("[a-z0-9]+", t.lower())], 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def semantic_chunks(docs: DataFrame, percentile: float = 0.85, least: int = 80, most: int = 300, code_max: int = 400, embed=hashed_vectors) -> DataFrame:
    """Chunks that begin where neighbouring sentences differ: (doc_id, chunk, start, end, n_words, text).

    A border is a distance (1 - dot product, 6 decimals) above the document's `percentile` of them. A chunk ends at a border
    once it has `least` words, and in any case before it would pass `most`. A sentence is never cut; code is as in `units`.
    """

    def spans_of(text: str) -> list[tuple[int, int, int]]:
        spans, level, fenced = marked_words(text)
        units = [u for lo, hi in (_cut(level >= 2, 0, len(level)) if len(level) else ()) for u in ([(lo, hi)] if fenced[lo] and hi - lo <= code_max else _cut(level >= 1, lo, hi))]
        if not units:
            return []
        vectors = embed([text[spans[a, 0] : spans[b - 1, 1]] for a, b in units])
        far = np.round(1 - (vectors[:-1] * vectors[1:]).sum(1), 6)
        border = np.concatenate([[False], far > (np.quantile(far, percentile) + 1e-9 if len(far) else 0)])
        total = [0, *np.cumsum([b - a for a, b in units]).tolist()]
        heads = [0]
        for i in range(1, len(units)):
            if total[i + 1] - total[heads[-1]] > most or (border[i] and total[i] - total[heads[-1]] >= least):
                heads.append(i)
        ends = [*heads[1:], len(units)]
        return [(int(spans[units[i][0], 0]), int(spans[units[j - 1][1] - 1, 1]), total[j] - total[i]) for i, j in zip(heads, ends, strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                rows += [(d, i, a, b, n, t[a:b]) for i, (a, b, n) in enumerate(spans_of(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "n_words", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, start int, end int, n_words int, text string")


#: Ids in one block: what a window over a large group sorts at once.
BLOCK = 65_536


def id_block(key: str) -> Column:
    return F.floor(F.col(key) / BLOCK)


def page_starts(pages: DataFrame, by: str) -> DataFrame:
    """Where each page (doc_id, a key; `by` groups) begins when a group's pages are joined by a blank line, in order of id.

    Sums run inside blocks of ids, and block totals run inside the group, so a group that holds most rows is still
    spread over many tasks. A null text has no length; null is a group of its own.
    """
    before = (Window.unboundedPreceding, -1)
    rows = pages.select(by, "doc_id", id_block("doc_id").alias("__block"), (F.length("text") + 2).alias("__n"))
    totals = rows.groupBy(by, "__block").agg(F.sum("__n").alias("__sum"))
    earlier = totals.select(F.col(by).alias("__by"), F.col("__block").alias("__b"), F.sum("__sum").over(Window.partitionBy(by).orderBy("__block").rowsBetween(*before)).alias("__earlier"))
    inside = F.sum("__n").over(Window.partitionBy(by, "__block").orderBy("doc_id").rowsBetween(*before))
    joined = rows.withColumn("__inside", inside).join(earlier, F.col(by).eqNullSafe(F.col("__by")) & F.col("__block").eqNullSafe(F.col("__b")))
    return joined.select(by, "doc_id", (F.coalesce("__earlier", F.lit(0)) + F.coalesce("__inside", F.lit(0))).cast("long").alias("start"))


def topic_breaks(vectors: DataFrame, by: str, percentile: float = 0.85) -> DataFrame:
    """Distances between consecutive vectors of a group; a break is a distance above the group's percentile.

    Neighbours are found inside blocks of ids; the last vector of a block meets the first of the next one. Distances
    are rounded, so the exact percentile counts at most two million values a group.
    """
    rows = vectors.where("vec_id IS NOT NULL").select(by, "vec_id", "embedding", id_block("vec_id").alias("__block"))
    order = Window.partitionBy(by, "__block").orderBy("vec_id")
    firsts = rows.groupBy(by, "__block").agg(F.min_by("embedding", "vec_id").alias("__first"))
    following = firsts.select(F.col(by).alias("__by"), F.col("__block").alias("__b"), F.lead("__first").over(Window.partitionBy(by).orderBy("__block")).alias("__following"))
    inside = rows.withColumn("__id", F.lead("vec_id").over(order)).withColumn("__vec", F.lead("embedding").over(order))
    joined = inside.join(following, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__block") == F.col("__b")))
    vectors = joined.select(by, "vec_id", "embedding", F.when(F.col("__id").isNotNull(), F.col("__vec")).otherwise(F.col("__following")).alias("next"))
    dot = F.aggregate(F.zip_with("embedding", "next", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    steps = vectors.where("next IS NOT NULL").select(by, "vec_id", F.round(1 - dot, 6).alias("distance"))
    limits = steps.groupBy(by).agg(F.percentile("distance", F.lit(percentile)).alias("limit"))
    return steps.join(limits, by).select(by, "vec_id", "distance", (F.col("distance") > F.col("limit") + F.lit(1e-9)).alias("is_break"))


def repeated_lines(docs: DataFrame, share: float = 0.02) -> DataFrame:
    """Line keys that stand in at least max(2, share of all) documents, with their count."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", tx.repeat_key(F.col("line")).alias("key")).where("key <> ''")
    counts = lines.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"))
    least = docs.agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * F.lit(share))).alias("least"))
    return counts.crossJoin(F.broadcast(least)).where("n_docs >= least").select("key", "n_docs")  # `least` is one row


def html_blocks(pages: DataFrame) -> DataFrame:
    """Text blocks of web pages: (page_id, block, text); scripts, styles and tags go, blocks without letters too."""
    body = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    parts = F.split(body, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|td|th|table|section|article|header|footer|nav|br|body|html)\b[^>]*>")
    rows = pages.select("page_id", F.posexplode(parts).alias("block", "raw"))
    text = F.trim(F.regexp_replace(tx.unescaped(F.regexp_replace("raw", r"<[^>]*>", "")), r"\s+", " "))
    return rows.select("page_id", "block", text.alias("text")).where(~tx.is_noise(F.col("text")))
