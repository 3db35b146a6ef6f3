"""Chunk sets and traces as JSON lines: round trips, and faults across tables."""

import json

from corpusmill.operators import reports
from corpusmill.sources import sets


def test_chunkset_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", f"text {i} é\n\"q\"", i, i + 1, "fixed", None, f"p{i % 2}", {"k": str(i)}) for i in range(30)], sets.CHUNK)
    parents = spark.createDataFrame([(f"p{i}", "whole", None, None, "parent", "S > T", None, None) for i in range(2)], sets.CHUNK)
    sets.write_chunkset(str(tmp_path), "fixed", {"size": 200, "overlap": 40}, rows.repartition(3), parents)
    got = sets.read_chunkset(spark, str(tmp_path), "fixed")
    assert got.params == {"size": "200", "overlap": "40"} and got.rejects.count() == 0
    assert sorted(map(str, got.rows.collect())) == sorted(map(str, rows.collect())) and sorted(map(str, got.parents.collect())) == sorted(map(str, parents.collect()))


def test_faults_across_tables(spark, tmp_path):
    row = lambda **more: json.dumps({"chunk_id": "a", "text": "t", "page_start": 1, "page_end": 2, "strategy": "s"} | more)
    lines = ['{"_params": {"size": 5}, "_strategy": "s"}', "", row(parent_id="p1"), row(chunk_id="b", parent_id="p2"), row(chunk_id="c", page_end=0), row(chunk_id="a", text="u"), row(chunk_id=None), row(chunk_id="d", colour="red"), "{broken", row(chunk_id="e", page_start="one"), row(chunk_id="f", parent_id="p3"), "[1]"]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    (tmp_path / "s.parents.jsonl").write_text("\n".join([row(chunk_id="p1"), row(chunk_id="p1", text="other"), row(chunk_id="p2"), "x"]))
    got = sets.read_chunkset(spark, str(tmp_path), "s")
    assert got.params == {"size": "5"} and sorted(r.chunk_id for r in got.rows.collect()) == ["a", "b"] and sorted(r.chunk_id for r in got.parents.collect()) == ["p1", "p2"]
    reasons = sorted((r.table, r.reason) for r in got.rejects.collect())
    assert reasons == sorted([("chunks", "ends before it begins"), ("chunks", "repeated id"), ("chunks", "no chunk_id"), ("chunks", "unknown key: colour"), ("chunks", "not a row of the schema"), ("chunks", "not a row of the schema"), ("chunks", "not a row of the schema"), ("chunks", "parent isn't in the set"), ("parents", "repeated id"), ("parents", "not a row of the schema")])
    assert {r.line for r in got.rejects.collect()} >= {"{broken", "x", lines[5]}


def test_set_without_parents_or_header(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"chunk_id": "a", "text": "t"}\n{"chunk_id": "b", "parent_id": "p"}')
    got = sets.read_chunkset(spark, str(tmp_path), "s")
    assert got.params == {} and [r.chunk_id for r in got.rows.collect()] == ["a"] and [r.reason for r in got.rejects.collect()] == ["parent isn't in the set"]


def test_traces_round_trip(spark, tmp_path):
    hits = spark.createDataFrame([(q, d, r, 1.0 / r) for q in (1, 2) for r, d in enumerate([7, 8, 9], 1)], "q_id long, doc_id long, rank int, score double")
    flat = reports.traced([("bm25", "retrieve", hits), ("context", "transform", hits.where("rank < 3"))])
    sets.write_traces(f"{tmp_path}/t", reports.traces(flat))
    bad = ['{"q_id": 9, "stages": [{"stage_no": 2}]}', '{"q_id": 8, "stages": [{"stage_no": 1, "hits": [{"rank": 1}, {"rank": 1}]}]}', '{"stages": []}', '{"q_id": 1, "stages": []}', "nonsense", '{"q_id": 6, "stages": []}']
    (tmp_path / "t" / "more.txt").write_text("\n".join(bad))
    got, rejects = sets.read_traces(spark, f"{tmp_path}/t")
    kept = sorted(map(str, got.where("q_id = 2").collect()))
    assert kept == sorted(map(str, reports.read_traces(reports.traces(flat)).where("q_id = 2").collect())) and len(kept) == 5
    assert sorted(r.reason for r in rejects.collect()) == ["a stage repeats a rank", "no question id", "not a row of the schema", "repeated id", "stages aren't numbered from 1"]
