"""Features of quality and toxicity against plain counts word by word, and compiled rules against their conditions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import features, quality, toxicity
from tests.llm.test_llm import AWKWARD, docs_of

SF = "/root/testdata/sf0.001"
LETTERS = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
DISGUISE = dict(zip(b"0134578@$!", b"oieastbasi", strict=True))


def split(raw):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]


def lower(raw):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def plain_stats(text):
    raw = (text or "").encode()
    w, lines = split(raw), raw.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    n, size = max(1, len(w)), max(1, len(raw))
    share = lambda test: sum(map(test, w)) / n
    chars = lambda test: sum(map(test, raw)) / size
    letters = lambda x: [b for b in x if b in LETTERS]
    return {
        "log_words": math.log1p(len(w)), "word_bytes": share(len), "upper": chars(lambda b: 65 <= b <= 90), "digit": chars(lambda b: 48 <= b <= 57), "end_mark": chars(lambda b: b in b"!?"), "comma_dot": chars(lambda b: b in b".,;:'\""),
        "symbol": chars(lambda b: 33 <= b < 127 and not chr(b).isalnum() and b not in b".,;:'\"!?|"), "pipe": chars(lambda b: b == 124), "other": chars(lambda b: b >= 128),
        "shouted": share(lambda x: sum(65 <= b <= 90 for b in x) >= 2 and all(65 <= b <= 90 for b in letters(x))), "capital": share(lambda x: 65 <= x[0] <= 90), "odd_end": share(lambda x: x[-1] not in LETTERS and x[-1] not in b".,;:"), "short_word": share(lambda x: len(x) <= 3),
        "distinct": len(set(w)) / n, "same_next": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "line_words": len(w) / max(1, len(lines)), "same_line": 1 - len(set(lines)) / len(lines) if lines else 0.0, "lone_symbol": share(lambda x: not letters(x)),
    }


def plain_lexicon(text, words, beginnings):
    w = split((text or "").encode())
    n, known = max(1, len(w)), dict.fromkeys(features.INSULTS, 1.0) | words
    rows = []
    for x in w:
        plain = lower(bytes(b for b in x if b in LETTERS)).decode("utf-8", "surrogateescape")
        weight = max([known.get(plain, 0.0), *(v for b, v in beginnings.items() if plain.encode("utf-8", "surrogateescape").startswith(b.encode()))])
        seen = bytes(DISGUISE.get(b, b) for b in lower(bytes(b for b in x if b in LETTERS or b in DISGUISE))).decode("utf-8", "surrogateescape")
        shown = known.get(seen, 0.0)
        rows.append((max(weight, shown), plain in features.INSULTS, plain in features.SECOND_PERSON, shown > 0 and weight == 0, any(b not in LETTERS for b in x[:-1]) and sum(b in LETTERS for b in x) >= 2))
    hits = [i for i, r in enumerate(rows) if r[0] > 0]
    near = sum(any(r[2] for r in rows[max(0, i - 5) : i + 6]) for i in hits)
    total = lambda k: sum(r[k] for r in rows)
    return {"hits": len(hits), "density": len(hits) / n, "fixed_density": total(1) / n, "near_you": near / n, "you": total(2) / n, "obfuscated": total(3) / n, "mixed": total(4) / n, "weight": total(0), "weight_density": total(0) / n}


def some_texts():
    rng = random.Random(12)
    pool = ["You", "are", "an", "IDIOT", "1d10t", "id-iot", "idiotic", "$tupid!", "m0ron,", "ça", "É", "x|y", "--", "42", "WOW!!", "ok.", "ok.", "trash", "u", "trashy", "c-lown?", "漢字", "don't"]
    return [" ".join(rng.choice(pool) + rng.choice(["", "", "\n", "\t\n\n"]) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(40)] + [t for _, t in AWKWARD] + ["a\nb\na\n", "\n", "\n\nx"]


def test_statistics_are_plain_counts(spark):
    texts = some_texts()
    rows = features.with_features(docs_of(spark, list(enumerate(texts))), "text").select("doc_id", "features").collect()
    for r in rows:
        want = plain_stats(texts[r.doc_id])
        assert list(want) == list(features.STATS)
        assert r.features == pytest.approx(list(want.values()), abs=1e-9), (texts[r.doc_id][:80] if texts[r.doc_id] else None)


def test_lexicon_is_plain_counts():
    words, beginnings = {"wow": 2.0, "idiot": 3.0}, {"trash": 1.5, "clow": 0.5}
    lexicon, texts = features.Lexicon(words, beginnings), some_texts()
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = features.row_features(lexicon, np.frombuffer(b"".join(raw), np.uint8), offsets)[:, len(features.STATS) :]
    for t, row in zip(texts, got, strict=True):
        want = plain_lexicon(t, words, beginnings)
        assert list(want) == list(features.LEXICON_STATS)
        assert row.tolist() == pytest.approx(list(want.values()), abs=1e-9), t


def test_compiled_rules_are_their_conditions(spark):
    rng = np.random.default_rng(4)
    x = rng.random((300, len(features.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = quality.fit_rules(x, y, trees=8)
    total = model.intercept + sum(w * quality._holds(rule, x) for rule, w in zip(model.rules, model.weights, strict=True))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, f array<double>")
    got = {r.i: r.s for r in df.select("i", model.column(F.col("f")).alias("s")).collect()}
    assert len(model.rules) > 1 and [got[i] for i in range(300)] == pytest.approx((1 / (1 + np.exp(-total))).tolist(), abs=1e-9)
    assert all(" if " in line for line in model.describe())


def test_scores_are_the_model_on_the_features(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.withColumns({"__toxicity": F.lit(1), "__stats": F.lit(2)}), toxic).collect()}
    for i in list(texts)[:40]:
        raw = np.frombuffer(texts[i].encode(), np.uint8)
        assert got[i] == pytest.approx(float(toxic.predict(features.row_features(toxic.lexicon, raw, np.array([0, len(raw)])))[0]), abs=1e-9)
    rules = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, rules).collect()}
    for i in list(texts)[:40]:
        x = np.array([list(plain_stats(texts[i]).values())])
        raw = rules.intercept + sum(w * float(quality._holds(rule, x)[0]) for rule, w in zip(rules.rules, rules.weights, strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-6)
