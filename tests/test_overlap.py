"""Documents that share most words with a question, against plain counts; what the search moves."""

import random

from corpusmill import catalog
from corpusmill.functions.text import STOPWORDS
from corpusmill.operators import blocks, overlap

from .oracle import differences


def _best(docs, questions, k):
    """(q_id, doc_id, score, rank) by plain Python."""
    words = lambda t: {w for w in (t or "").lower().split() if w not in STOPWORDS}
    have, out = {}, []
    for i, text in docs:
        if i is not None:
            have.setdefault(i, set()).update(words(text))
    for q, text in questions:
        if q is not None:
            ranked = sorted((-len(words(text) & have[i]), i) for i in have if words(text) & have[i])[:k]
            out += [(q, i, float(-s), n + 1) for n, (s, i) in enumerate(ranked)]
    return sorted(out)


def test_most_shared(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    some = lambda most: " ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randint(0, most)))
    docs = [(i * 7 - 900 + (1 << 40) * (i % 3), some(40)) for i in range(500)] + [(-5, None), (-4, "the of"), (None, "w0 w1"), (600, "w1 W2"), (600, "w2 w3"), (1 << 62, " ".join(words))]
    questions = [(i * 11 - 300, some(30)) for i in range(120)] + [(-1, None), (-2, "unknown words"), (-3, "the"), (-4, " ".join(words)), (None, "w0"), (7_000, "w59")]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(questions, "q_id long, text string")
    for k, sizes in ((5, (64, 16)), (1, (16_384, 4_096)), (7, (3, 200))):
        got = sorted(map(tuple, overlap.most_shared(*tables, k, sizes).select("q_id", "doc_id", "score", "rank").collect()))
        assert got == _best(docs, questions, k)
    assert overlap.most_shared(tables[0].limit(0), tables[1], 5).count() == 0 == overlap.most_shared(tables[0], tables[1].limit(0), 5).count()


def test_blocks(spark, monkeypatch):
    """Few rows are held at once, and an id isn't split over blocks."""
    monkeypatch.setattr(blocks, "ROWS", 50)
    run = overlap.packed(spark.range(30).selectExpr("id", "explode(sequence(0L, id % 7)) AS word").repartition(3), 30, 8).collect()
    ids = [int.from_bytes(r.ids[i : i + 8], "little") for r in run for i in range(0, len(r.ids), 8)]
    assert sorted(ids) == list(range(30)) and max(len(r.ids) // 8 for r in run) <= 8
    assert sum(len(r.places) // 2 for r in run) == sum(i % 7 + 1 for i in range(30))


def test_arms_move_no_pairs(spark, tmp_path):
    """Documents and questions that all share words: what is shuffled doesn't grow with their product."""
    n, conversations = 3_000, 500
    spark.range(n).selectExpr("id AS doc_id", "concat('alpha beta gamma w', id % 40, ' delta x', id) AS text", "'en' AS lang", "'s' AS source", "30L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(conversations).crossJoin(spark.range(3).withColumnRenamed("id", "t")).selectExpr("id AS conv_id", "t AS turn", "if(t % 2 = 0, 'user', 'assistant') AS role", "concat('alpha gamma delta y', id, ' w', id % 40) AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(60_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    catalog.QUERIES["arms_summary"](spark, str(tmp_path)).collect()
    assert shuffled() - before < 2_000_000
    for name in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels".split():
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert not differences(spark, catalog.QUERIES["arms_summary"], catalog.ORACLES["arms_summary"], str(tmp_path))
