"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed in cells (source, language, topic). Raking scales the cells until their sums meet the target weight
of every source, language and topic: SWEEPS times, one dimension after the other. Each step is a grouped sum, combined
before the shuffle, and a join on the table of cells (up to BROADCAST_ROWS cells: sums over windows, all steps in one job, with
the same numbers), so any number of categories is raked and none is folded. A
document's probability is its cell's raked weight over its tokens, divided by the highest such ratio, so none exceeds 1
and the expected mix is the target. A hash of the id draws.

Default targets temper the natural shares: share^ALPHA, normalised. After the sweeps the largest gap between a category's
share and its target is measured; over WIDE_GAP it is told as a warning, since such targets can't be met together (a
category that isn't there, or combinations that don't occur).

Defined results: null source or lang is the category "unknown"; null or empty text has no tokens (its cell's
probability still holds; a cell without any tokens has probability 1); rows that share an id share the draw; a null id
is drawn by its text; an empty table gives no rows; input columns named as the outputs are replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .storage import join_small, written

ALPHA, SWEEPS, SEED, WIDE_GAP = 0.85, 10, "mix", 0.01
DIMENSIONS = ("source", "lang", "topic")
_WORD = r"[^\x20\x09-\x0D]+"
#: What a text shows, tested in this order.
TOPIC = "CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, 'License') THEN 'licence' WHEN {digit} THEN 'figures' ELSE 'prose' END"


def _with_cells(docs: DataFrame) -> DataFrame:
    """docs with __source, __lang, __topic."""
    out = docs.withColumn("__topic", F.expr(TOPIC.format(digit="text rlike '[0-9]'")))
    for c in ("source", "lang"):
        out = out.withColumn(f"__{c}", F.coalesce(F.col(c), F.lit("unknown")))
    return out


def _shares(cells: DataFrame, key: str, alpha: float) -> DataFrame:
    """(key, t): the tempered share of every category."""
    powers = cells.groupBy(key).agg(F.pow(F.sum("tokens"), F.lit(alpha)).alias("t"))
    total = powers.agg(F.sum("t")).first()[0] or 1.0
    return powers.withColumn("t", F.col("t") / F.lit(total))


def largest_gap(cells: DataFrame, wanted: dict[str, DataFrame]) -> float:
    """The largest difference between a category's share of the weights and its target, 0 without weights."""
    total = cells.agg(F.sum("w")).first()[0] or 0.0
    gaps = [0.0]
    for key, targets in wanted.items():
        sums = cells.groupBy(key).agg(F.sum("w").alias("s")).join(targets, key, "full")
        gaps.append(sums.agg(F.max(F.abs(F.coalesce("s", F.lit(0.0)) / F.lit(total or 1.0) - F.coalesce("t", F.lit(0.0))))).first()[0] or 0.0)
    return max(gaps) if total else 0.0


def rates(docs: DataFrame, alpha: float = ALPHA, sweeps: int = SWEEPS, targets: DataFrame | None = None) -> DataFrame:
    """Cells with their probability.

    targets(dimension, category, weight), if given, replaces the tempered shares; categories it lacks get none.
    """
    tokens = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0))
    keys = [f"__{d}" for d in DIMENSIONS]
    cells = written(_with_cells(docs).groupBy(*keys).agg(F.sum(tokens).cast("double").alias("tokens")), "cells")
    n = cells.count()
    wanted = {}
    for d, k in zip(DIMENSIONS, keys, strict=True):
        shares = _shares(cells, k, alpha) if targets is None else targets.where(F.col("dimension") == d).select(F.col("category").alias(k), F.col("weight").cast("double").alias("t"))
        wanted[k] = written(shares, "targets")
    cells = cells.withColumn("w", F.col("tokens"))
    if n <= storage.BROADCAST_ROWS:  # few cells: all sweeps are one job, and no window holds more rows than could be broadcast
        for k in keys:
            cells = cells.join(wanted[k].withColumnRenamed("t", f"t{k}"), k, "left")
        for k in keys * sweeps:
            cells = cells.withColumn("s", F.sum("w").over(Window.partitionBy(k)))
            cells = cells.withColumn("w", F.when(F.col("w") > 0, F.col("w") * F.coalesce(f"t{k}", F.lit(0.0)) / F.col("s")).otherwise(F.lit(0.0)))
        cells = written(cells.select(*keys, "tokens", "w"), "cells")
        sweeps = 0
    for _ in range(sweeps):
        for k in keys:
            sums = cells.groupBy(k).agg(F.sum("w").alias("s")).join(wanted[k], k, "left")
            scaled = F.when(F.col("w") > 0, F.col("w") * F.coalesce("t", F.lit(0.0)) / F.col("s")).otherwise(F.lit(0.0))
            cells = written(join_small(cells, sums, k, "inner", n).select(*keys, "tokens", scaled.alias("w")), "cells")
    gap = largest_gap(cells, wanted)
    if gap > WIDE_GAP:
        warnings.warn(f"the targets can't be met together: a category's share is {gap:.3f} off its target", stacklevel=3)
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
    most = cells.agg(F.max(ratio)).first()[0] or None
    return cells.select(*keys, F.coalesce(F.round(ratio / F.lit(most).cast("double"), 9), F.lit(1.0)).alias("probability"))


def draw(id_col: str = "doc_id", text_col: str = "text", seed: str = SEED):
    """A number in [0, 1) from a hash of the id."""
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """docs with topic, probability and sampled. docs has doc_id, text, source and lang."""
    docs = docs.drop("topic", "probability", "sampled")
    cells = written(rates(docs, **settings), "rates")
    keyed = join_small(_with_cells(docs), cells, [f"__{d}" for d in DIMENSIONS], "left")
    return keyed.select(*docs.columns, F.col("__topic").alias("topic"), F.coalesce("probability", F.lit(1.0)).alias("probability")).withColumn("sampled", draw() < F.col("probability"))


def _oracle() -> str:
    topic = TOPIC.format(digit="regexp_matches(text, '[0-9]')")
    sql = [
        rf"d AS (SELECT doc_id, coalesce(source, 'unknown') AS s0, coalesce(lang, 'unknown') AS l0, {topic} AS topic, text, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::DOUBLE AS tokens FROM documents)",
        "e AS MATERIALIZED (SELECT *, s0 AS source, l0 AS lang FROM d)",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens, sum(tokens) AS w FROM e GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        sql.append(f"t_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens), {ALPHA}e0) / sum(pow(sum(tokens), {ALPHA}e0)) OVER () AS t FROM c0 GROUP BY {d})")
    n = 0
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            sql.append(f"c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN w > 0 THEN w * t / sum(w) OVER (PARTITION BY {d}) ELSE 0e0 END AS w FROM c{n} JOIN t_{d} USING ({d}))")
            n += 1
    sql.append(f"r AS (SELECT source, lang, topic, coalesce(round((CASE WHEN tokens > 0 THEN w / tokens END) / max(CASE WHEN tokens > 0 THEN w / tokens END) OVER (), 9), 1e0) AS probability FROM c{n})")
    u = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT / 4294967296e0"
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, topic, probability, {u} < probability AS sampled FROM e JOIN r USING (source, lang, topic)"


ORACLE = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")).select("doc_id", "topic", "probability", "sampled")
