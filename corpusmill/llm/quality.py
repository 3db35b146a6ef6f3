"""Quality classifier: a sparse ensemble of conjunctive rules.

Boosted shallow trees over text statistics propose rules (each path from a root is a conjunction of thresholds); a
lasso logistic regression keeps few of them; the kept rules become one Spark column expression over the statistics.
The fit sees at most SAMPLE labelled rows, chosen by a hash of the id; every row of the corpus is scored in one pass
without a shuffle.

Defined results: null text counts as empty and gets a score; without labels of both classes every score is the base
rate (0.5 without any label); a null id is held out of nothing and scored like others; other columns are kept, except
that columns named as the outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import LEXICON_STATS, STATS, Lexicon, with_features
from .storage import written
from .trees import boost, lasso_logistic

SAMPLE = 20_000
HELD_OUT_OF = 5
Rule = tuple[tuple[int, float, bool], ...]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> DataFrame:
    """(id, text, y) of at most `rows` labelled ids that aren't held out; the choice follows a hash of the id.

    An id on several rows counts once, with its least text and its highest label, so the sample is the same each time.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(~held_out).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    found = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).join(F.broadcast(chosen), id_col)  # `rows` rows at most
    return written(found.groupBy(id_col, "y").agg(F.min(text_col).alias(text_col)), "sample")


def sampled_features(sample: DataFrame, lexicon: Lexicon | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, in the order of ids."""
    got = with_features(sample, text_col, lexicon).select(id_col, "y", "features").orderBy(id_col).collect()  # at most SAMPLE rows of numbers
    width = len(STATS) + (len(LEXICON_STATS) if lexicon else 0)
    return np.array([r.features for r in got], float).reshape(len(got), width), np.array([r.y for r in got], float)


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def column(self, features: Column) -> Column:
        """The score as a Spark expression over an array of statistics."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for f, t, below in rule:
                value = features.getItem(f)
                test = test & ((value < F.lit(t)) if below else (value >= F.lit(t)))
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATS[f]} {'<' if below else '>='} {t:.4g}" for f, t, below in rule) for rule, w in zip(self.rules, self.weights, strict=True)]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, t, below in rule:
        out &= (x[:, f] < t) if below else (x[:, f] >= t)
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, penalty: float = 0.0005) -> RuleModel:
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(p / (1 - p))), [], [])
    _, forest = boost(x, y, trees, depth=3, rate=0.15)
    unique: dict[bytes, Rule] = {}
    for rule in sorted({p for t in forest for p in t.paths()}, key=lambda r: (len(r), r)):
        held = _holds(rule, x)
        if 3 <= held.sum() <= len(y) - 3:
            unique.setdefault(np.packbits(held).tobytes(), rule)
    rules = list(unique.values())  # at most 14 paths a tree
    matrix = np.stack([_holds(r, x) for r in rules], 1).astype(float)
    intercept, w = lasso_logistic(matrix, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(intercept, [rules[k] for k in kept], [float(w[k]) for k in kept])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    held_out = F.lit(False) if held_out is None else held_out
    return fit_rules(*sampled_features(labelled_sample(docs, labels, label, held_out, id_col, text_col), None, id_col, text_col))


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted."""
    scored = with_features(docs, text_col, name="__stats").withColumn("score", model.column(F.col("__stats")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("__stats")


def held_out_fold(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = held_out_fold("doc_id", HELD_OUT_OF, 0)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", held)
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
