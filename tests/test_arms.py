"""The arms experiment on literal items."""

from corpusmill.operators import arms

ITEMS = "item long, expect string, message string, standalone string, history array<struct<question:string,answer:string>>"


def test_arms(spark):
    past = [("what is a filter", "a bit array")]
    items = spark.createDataFrame([(1, "answer", "and its size?", "size of a filter", past), (2, "answer", "and its cost?", "cost of a filter", past * 9), (3, "clarify", "which one?", None, past), (4, "answer", "plain question", "plain question", None), (5, "answer", "and that?", "x", past), (6, "answer", None, None, past)], ITEMS)
    replies = spark.createDataFrame([(1, "rewrite", "size of a filter", False), (2, "clarify", None, False), (3, "clarify", None, True), (4, "rewrite", "never used", False)], "item long, status string, question string, named boolean")
    gold = spark.createDataFrame([(1, 10), (2, 20), (4, 40)], "item long, doc_id long")
    known = {"size of a filter": 10, "cost of a filter": 20, "plain question": 40}
    seen = []

    def search(questions):
        seen.extend(r.text for r in questions.collect())
        return spark.createDataFrame([(r.q_id, known[r.text], 1) for r in questions.collect() if r.text in known], "q_id long, doc_id long, rank int")

    staged = {r.item: r for r in arms.forced(items, 6).collect()}
    assert len(staged[2].history) == 6 and staged[2].history_words == 42 and staged[4].history == [] and not staged[4].fires and staged[1].fires
    row = arms.run(items, replies, gold, search).first().asDict()
    assert len(seen) == len(set(seen))
    assert row == {"items": 6, "n": 5, "hit_off": 0.2, "hit_on": 0.4, "hit_oracle": 0.6, "wins": 1, "ties": 4, "losses": 0, "gap_closed": 0.5, "gate_calls": 4, "fallbacks": 1, "false_clarify": 1, "clarify_n": 1, "clarify_asked": 1, "clarify_named": 1}
    assert arms.run(items.limit(0), replies, gold, search).first().n == 0
