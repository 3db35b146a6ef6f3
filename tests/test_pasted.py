"""Pasted objects: what is repaired, what is listed, what is set aside."""

import json

from corpusmill.sources import pasted

GOOD = {"id": "a", "question": "q?", "answerable": True, "gold_pages": [[1, 2]], "notes": "plain"}
TEXT = (
    json.dumps(GOOD) + ' {"id": "b", "question": "3 \\d > 2 \\\\ x", "must_not_contain": "one", "notes": "he said "no" to\nit"}\n\n'
    '{"id": "c", "ground_truth_answer": "x &gt; y &amp; z", "answerable": true, "gold_pages": [1, 2]}{"id": "broken", "question": }\n'
    '{ "id": null, "notes": "n"} {"id": "d", "evidence_terms": ["é", "}{"], "must_not_contain": ["[x]"], "notes": "fine \\"already\\""}  '
)


def read(spark, text=TEXT):
    rows, rejects = pasted.questions(pasted.pieces(spark.createDataFrame([(7, text), (8, None), (9, " \n")], "source_id long, text string")))
    return {r.id: r for r in rows.collect()}, rejects.orderBy("nth").collect()


def test_pasted_objects(spark):
    rows, rejects = read(spark)
    assert set(rows) == {"a", "b", "c", "d"} and {r.source for r in rows.values()} == {7}
    assert rows["a"].repairs == [] and rows["a"].problem is None and rows["a"].notes == "plain" and [list(p) for p in rows["a"].gold_pages] == [[1, 2]]
    assert rows["b"].question == "3 d > 2 \\ x" and rows["b"].notes == 'he said "no" to\nit' and rows["b"].must_not_contain == ["one"]
    assert rows["b"].repairs == [pasted.ESCAPES, pasted.NOTES, pasted.LISTED]
    assert rows["c"].reference_answer == "x > y & z" and rows["c"].repairs == [pasted.ENTITIES, pasted.RENAMED] and rows["c"].problem.startswith("gold_pages") and rows["c"].notes == ""
    assert rows["d"].evidence_terms == ["é", "}{"] and rows["d"].must_not_contain == ["[x]"] and rows["d"].notes == 'fine "already"' and rows["d"].repairs == []
    assert [(r.nth, r.reason) for r in rejects] == [(3, "not a JSON object"), (4, "no id")] and rejects[0].raw == '{"id": "broken", "question": }'


def test_objects_survive_any_neighbour(spark):
    rows, _ = read(spark, "\n".join([json.dumps(GOOD | {"id": "x"}), '{"id": "y", "notes": "unclosed }', json.dumps(GOOD | {"id": "z"})]))
    assert set(rows) == {"x", "z"}
