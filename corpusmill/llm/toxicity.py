"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a lexicon (a fixed list of insults plus words and word beginnings that toxic labels show far
more often than others), nearness to second-person words, capitals, punctuation, disguised and mixed words, and the
general text statistics. Lexicon, trees and calibration are fitted on at most SAMPLE labelled rows (a hash of the id
chooses them): two fifths give the lexicon, the others the trees and, a quarter of them, the calibration; all rows are scored in one pass without a shuffle.

Defined results: as in `quality`: null text is empty and gets a score; without labels of both classes every score is
the base rate (0.5 without any label); if the calibration's rows are all of one class, scores stay uncalibrated; other columns are kept, those named as the outputs are replaced; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import PREFIXES, Lexicon, of_text, row_features
from .quality import held_out_fold, labelled_sample, sampled_features
from .trees import Tree, boost, isotonic, sigmoid

SAMPLE = 12_000
THRESHOLD = 0.7
ENTRIES = 400
_WORD = r"([^\x00-\x40\x5B-\x60\x7B-\x7F]+)"


def learn_lexicon(sample: DataFrame, text_col: str = "text", entries: int = ENTRIES, lift: float = 4.0, least_docs: int = 5) -> Lexicon:
    """Words and beginnings whose share of documents is at least `lift` times as high among label 1.

    Words are counted once a document; the words of the bounded sample are counted on Spark, and only the best
    `entries` reach the driver.
    """
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = sample.select("y", F.monotonically_increasing_id().alias("row"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(_WORD), F.lit(1)))).alias("w"))
    forms = words.select("row", "y", F.explode(F.array_distinct(F.array(F.concat(F.lit("="), "w"), *(F.when(F.length("w") > k, F.substring("w", 1, k)) for k in PREFIXES)))).alias("form")).where("form IS NOT NULL")
    counts = forms.groupBy("form", "row", "y").agg(F.lit(1)).groupBy("form").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n"))
    totals = sample.agg(F.sum("y"), F.count(F.lit(1))).first()
    toxic, clean = int(totals[0] or 0), int(totals[1]) - int(totals[0] or 0)
    if not toxic or not clean:
        return Lexicon({}, {})
    gain = (F.col("t") / toxic) / ((F.col("n") - F.col("t") + 1.0) / clean)
    best = counts.where(F.col("t") >= least_docs).withColumn("lift", gain).where(F.col("lift") >= lift).orderBy((F.col("t") * F.log("lift")).desc(), "form").limit(entries).collect()
    words_ = {r.form[1:]: float(np.log(r.lift)) for r in best if r.form.startswith("=")}
    return Lexicon(words_, {r.form: float(np.log(r.lift)) for r in best if not r.form.startswith("=")})


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    base: float
    trees: list[Tree]
    steps: tuple[np.ndarray, np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for tree in self.trees:
            raw += tree.predict(x)
        return np.interp(sigmoid(raw), *self.steps) if self.trees else sigmoid(raw)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> ToxicityModel:
    held_out = F.lit(False) if held_out is None else held_out
    sample = labelled_sample(docs, labels, label, held_out, id_col, text_col, rows)
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("lexicon")), F.lit(5))
    lexicon = learn_lexicon(sample.where(part < 2), text_col)
    x, y = sampled_features(sample.where(part >= 2), lexicon, id_col, text_col)
    aside = np.arange(len(y)) % 4 == 3
    base, trees = boost(x[~aside], y[~aside], trees=80, depth=3, rate=0.15)
    model = ToxicityModel(lexicon, base, trees, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    if trees and 0 < y[aside].sum() < aside.sum():  # one class alone would calibrate every score to 0 or 1
        model.steps = isotonic(model.predict(x[aside]), y[aside])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    score = of_text(lambda data, offsets: model.predict(row_features(model.lexicon, data, offsets)), T.DoubleType())
    scored = docs.withColumn("score", score(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic."""
    held = held_out_fold("doc_id", 3, 1)
    columns = docs.columns
    score = "__toxicity"  # docs may have columns named as the outputs
    model = fit(docs, labels, held_out=held)
    made = of_text(lambda data, offsets: model.predict(row_features(model.lexicon, data, offsets)), T.DoubleType())
    return docs.withColumn(score, made(F.col("text"))).where(F.col(score) < THRESHOLD).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = held_out_fold("doc_id", 3, 1)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", held)
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
