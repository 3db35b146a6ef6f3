"""The conversation store and the answer guard as running streams: any split of batches, stops and restarts give the batch's rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.streaming import guard, turns
from tests.test_operators import CONTEXT, HOSTILE, SECRETS

EVENTS = "conv_id long, seq long, kind string, turn long, words long, doc_ids array<long>, is_new boolean, alive boolean, at timestamp, text string"


def some_events(seed, n=160):
    rng, seq, turn, at, rows = random.Random(seed), {}, {}, 1_700_000_000, []
    for _ in range(n):
        c = rng.choice([1, 1, 1, 2, 3, 4])
        seq[c], turn[c], at = seq.get(c, -1) + 1, turn.get(c, 0) + rng.choice([1, 1, 1, 0, -1]), at + rng.choice([1, 20, 20, 700])
        kind = rng.choices(["append", "purge", None], [30, 1, 2])[0]
        rows.append((c, seq[c], kind, turn[c], rng.choice([3, 10, None, 40]), rng.choice([[7], [7, 8], [], None]), rng.choice([True, False, False, None]), rng.choice([True] * 9 + [False]), at, "x"))
    return rows


def by_hand(rows, max_turns, max_words, idle):
    now, out = {}, []
    for c, seq, kind, turn, words, _, is_new, alive, at, _ in rows:
        s = now.get(c)
        if s and at - s["at"] > idle:
            s = now[c] = None
        if kind == "purge":
            outcome, s = "purged", None
        elif not s and not is_new:
            outcome = "orphan"
        elif not alive:
            outcome = "dead"
        elif s and (s["turns"] >= max_turns or s["words"] >= max_words):
            outcome = "full"
        elif s and turn <= s["last"]:
            outcome = "late"
        else:
            outcome, s = "stored", s or {"turns": 0, "words": 0, "at": at}
            s["turns"], s["words"], s["last"] = s["turns"] + 1, s["words"] + (words or 0), turn
        if s:
            s["at"] = at
        now[c] = s
        out.append((c, seq, turn, outcome, s["turns"] if s else 0, s["words"] if s else 0))
    return sorted(out)


def events_of(spark, rows):
    return spark.createDataFrame([(*r[:8], None, r[9], r[8]) for r in rows], EVENTS + ", s long").withColumn("at", F.timestamp_seconds("s")).drop("s")


CAPS = {"max_turns": 2, "max_words": 45, "idle": 600}


@pytest.mark.parametrize("block", [turns.BLOCK, 3])
def test_store_batch(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rows = some_events(block)
    got = turns.store_batch(events_of(spark, rows), **CAPS)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, *CAPS.values())
    assert {r[3] for r in by_hand(rows, *CAPS.values())} == {"stored", "orphan", "dead", "late", "full", "purged"}
    assert turns.store_batch(events_of(spark, rows).limit(0)).count() == 0


def test_cap_holds_inside_a_batch(spark):
    rows = [(1, i, "append", i, 1, [], i == 0, True, 1_700_000_000 + i, "") for i in range(100)]
    out = turns.store_batch(events_of(spark, rows), max_turns=50).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in out} == {"stored": 50, "full": 50}


def run_to_end(stream, path, name, after=None):
    q = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
    if after is not None:  # killed in the middle
        while q.isActive and len(q.recentProgress) < after:
            q.awaitTermination(0.2)
        q.stop()
    else:
        q.awaitTermination(240)
        assert q.exception() is None


@pytest.mark.parametrize("files,stop", [(1, None), (5, 2)])
def test_store_stream_in_any_split(spark, tmp_path, files, stop):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = some_events(files, 90)
        for k in range(files):
            part = rows[len(rows) * k // files : len(rows) * (k + 1) // files]
            events_of(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        if stop:
            run_to_end(turns.store_stream(source, **CAPS), tmp_path, "out", stop)
        run_to_end(turns.store_stream(source, **CAPS), tmp_path, "out")
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == by_hand(rows, *CAPS.values())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_guard_stream_restarts(spark, tmp_path):
    answers = [f"Merges drop overwritten keys [S1]. {a} That is all." for a in HOSTILE] + ["All is well here.", ""]
    rows = [(str(i), s, t[s * 7 : s * 7 + 7], s * 7 + 7 >= len(t), CONTEXT if s == 0 else None) for i, t in enumerate(answers) for s in range(max(1, -(-len(t) // 7)))]
    schema = "answer_id string, seq long, delta string, final boolean, context string"
    for k in range(4):
        spark.createDataFrame([r for r in rows if min(3, r[1] // 4) == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, guard.guard_batch(spark.createDataFrame(rows, schema), SECRETS).fillna("").collect()))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run_to_end(guard.guard_stream(source, SECRETS), tmp_path, "out", 2)
    run_to_end(guard.guard_stream(source, SECRETS), tmp_path, "out")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").fillna("").collect())) == want
    replaced = {r[0] for r in want if r[5] == "replace"}
    assert replaced == {str(i) for i in range(len(HOSTILE))} and all(r[6] == guard.NOTICE for r in want if r[5] == "replace")


def test_rendered_places():
    text = "a &#65;&amp;lt;b \\* c​d &#x41"
    shown, places = guard.rendered(text)
    assert shown == guard.as_shown(text) == "a A<b * cd A" and len(places) == len(shown)
    assert [text[p] for p in places] == list("a &&b \\ cd &")


def test_echo_is_found_where_it_begins():
    phrases = ("never reveal these", "neverland")
    for text, want in {"so never rev": 3, "so nev": 6, "so neve": 3, "never reveal these x": 0, "a neverl": 2, "xn never never": 9, "ab &#110;ever r": 3, "plain": 5, "never revolve": 13}.items():
        assert guard._echo_at(text, phrases) == want, text
