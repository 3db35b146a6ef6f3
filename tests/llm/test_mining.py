"""Collocations, language identification and hard negatives against brute force, and their awkward inputs."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bitmap, collocations, hard_negatives, language
from tests.llm.test_llm import AWKWARD, LONG, docs_of

SF = "/root/testdata/sf0.001"


def phrases_by_hand(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        mine = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in mine.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and count[q := p[i:j]] <= a}
        scored = []
        for p, a in mine.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts_with_phrases(seed):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(40)]
    fixed = [[rng.choice(rare) for _ in range(rng.randint(2, 7))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 60)):
            w += rng.choice(fixed) if rng.random() < 0.2 else [rng.choice(common if rng.random() < 0.7 else rare)]
            if rng.random() < 0.1:
                w[-1] += rng.choice(".,;:!?")
        rows.append((("xx", "yy", None, "und")[i % 4], " ".join(w).replace("c1", "C1") if i % 5 else "a a a a a a"))
    return rows + [("xx", None), ("yy", ""), ("zz", "alone here"), (None, " \t\n.;")]


@pytest.mark.parametrize("least,top,least_step", [(4, 2000, 1), (4, 7, 1), (6, 20, 10**9), (10**6, 5, 1)])
def test_collocations_brute_force(spark, least, top, least_step):
    rows = texts_with_phrases(least + top)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit(1)).withColumn("w1", F.lit("x"))
    got = collocations.collocations(df, least=least, top=top, least_step=least_step)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, least, top)


def test_collocations_awkward(spark):
    assert collocations.collocations(docs_of(spark, []).select("lang", "text")).count() == 0
    rows = [("en", t) for _, t in AWKWARD]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=50)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 50, 2000)


def test_phrase_hash_is_sparks(spark):
    x = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, (3, 40))
    want = [r[0] for r in spark.createDataFrame([tuple(int(v) for v in c) for c in x.T], "a long, b long, c long").select(F.xxhash64("a", "b", "c")).collect()]
    assert collocations.phrase_hash(list(x)).view(np.int64).tolist() == want


def test_bitmap_has_all_and_few_others(spark):
    rng = np.random.default_rng(5)
    mine, others = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 5000)
    b = bitmap.Bitmap.of(spark.createDataFrame([(int(v),) for v in mine], "h long"), "h")
    assert b.has(mine).all() and b.has(others).mean() < 0.1


def subwords_by_hand(text):
    out = Counter()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        out["whole", w] += 1
        out.update(("part", (b" " + w + b" ")[i : i + n]) for n in language.SIZES for i in range(len(w) + 3 - n))
    return out


def test_subwords_of_words():
    from tests.llm.test_llm import random_texts

    texts = ["", "a", "Ab ab, AB-ab é漢 1x", "one two one", *(t or "" for _, t in random_texts(4)[:30])]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    words = language.Subwords(data, offsets)
    table = np.random.default_rng(2).normal(size=(language.BUCKETS, 3))
    mean, rows = words.means(table), list(words.counts())
    by_part = {}
    for i, t in enumerate(texts):
        want = subwords_by_hand(t)
        single = language.Subwords(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
        assert len(single.bucket) == sum(1 for _ in subwords_by_hand(" ".join(sorted({w.lower() for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", t)}))).elements())
        bucket, share = rows[i]
        assert share.sum() == pytest.approx(1 if want else 0, abs=1e-4)
        assert np.allclose(mean[i], (table[bucket] * share[:, None]).sum(0), atol=1e-5)
        by_part[t] = sum(want.values())
    assert by_part["one two one"] == 3 + 3 * sum(3 + 3 - n for n in language.SIZES)


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    got = language.query(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and 0 < len(held) < len(got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.accepted for r in got) > 0.9 * len(got)
    taken = [r for r in held if r.accepted]
    assert sum(r.lang_pred == truth[r.doc_id] for r in taken) >= 0.99 * len(taken)


def test_language_awkward(spark):
    rows = [*AWKWARD, (30, "123 !? 45"), (31, "é"), (32, "→ ∑ 5"), (33, "漢字")]
    docs = docs_of(spark, rows)
    out = language.identify(docs, language.fit(docs))
    assert {"kept", "id", "n_chars", "lang_pred", "score", "accepted"} <= set(out.columns)
    for r in out.collect():
        lost = not re.search(r"[^\W\d_]", r.text or "")
        assert (r.lang_pred, r.score) == ("und", 0.0) if lost else (r.lang_pred == "en" and r.score == 1.0)
    empty = docs_of(spark, [])
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(empty)).collect()} == {"und"}


def test_accepted_scores_are_precise():
    score, right = np.array([0.9, 0.9, 0.8, 0.7, 0.6, 0.5]), np.array([1, 1, 1, 1, 0, 1])
    assert language.accept_from(score, right, 1.0) == 0.7 and language.accept_from(score, right, 0.8) == 0.5
    assert language.accept_from(score, 1 - right, 0.9) == 2.0 and language.accept_from(score[:0], right[:0]) == 2.0
    rng = np.random.default_rng(1)
    logits, y = rng.normal(size=(400, 3)) * 3, rng.integers(0, 3, 400)
    assert language.temperature(logits, y) > 5 and language.temperature(np.eye(3)[y] * 0.5, y) < 0.5


def negatives_by_hand(rows, positives=5, negatives=5):
    fine = {}
    for i, label, v in sorted((r for r in rows if None not in r[:2] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], [math.floor(256 * x) for x in r[2]])):
        fine.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in fine.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, (other, w) in fine.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            found = [x for x in scores if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 17])
def test_hard_negatives_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i * 10), int(rng.integers(0, 3)), [float(np.float32(x)) for x in (centres[i % 6] + rng.normal(size=8) * 0.3) * rng.choice([0.1, 0.3, 1, 1.2])]) for i in range(400)]
    rows += [(4000 + i, i % 2, rows[7][2]) for i in range(30)] + [(200, 9, [1.0, 2.0]), (200, 1, [0.5]), (5000, 1, []), (5100, None, [1.0]), (None, 1, [1.0]), (5200, 1, None), (5300, 1, [float("nan")]), (5400, 0, [float("inf"), 1.0]), (5500, 0, [None, 1.0]), (5600, 2, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"id": F.lit("x"), "rank": F.lit(7), "score": F.lit(1)})
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    got = hard_negatives.hard_negatives(df, F.expr("vec_id % 100 = 0"), F.col("label"))
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)
    assert hard_negatives.hard_negatives(df.limit(0), F.expr("vec_id % 100 = 0"), F.col("label")).count() == 0


def test_anchor_batches_change_nothing(spark, monkeypatch):
    want = sorted(map(tuple, hard_negatives.query(spark, "/root/testdata/sf0.01").collect()))
    monkeypatch.setattr(hard_negatives, "BATCH_BYTES", 1500)
    assert want and sorted(map(tuple, hard_negatives.query(spark, "/root/testdata/sf0.01").collect())) == want


def test_feasible_ranges_lose_nothing():
    """Pruning by length and coordinates keeps every pair that reaches its least score, and leaves out most of the others."""
    rng = np.random.default_rng(6)
    pack = lambda m: hard_negatives.Block(np.arange(len(m)).tobytes(), np.zeros(len(m), np.int64).tobytes(), np.ascontiguousarray(m, np.int64).tobytes())
    sharp = rng.normal(size=(2000, 12)) ** 3 * 100
    rows, anchors = pack(sharp), pack(sharp[:40] * 1.1)
    score = anchors.rows @ rows.rows.T
    least = np.array([np.sort(s)[-20] for s in score])
    got = {(a, r): s for x in hard_negatives.candidates(anchors, rows, least) for a, r, s in zip(*map(list, x), strict=True)}
    assert all(got.get((a, r)) == score[a, r] for a, r in zip(*np.nonzero(score >= least[:, None]), strict=True))
    assert len(got) < score.size / 10
    assert LONG  # the long text of the other tests is used by AWKWARD
