"""The conversation store as a stream: turns appended under caps, late and orphaned writes told apart, documents' deletes.

events(conv_id, seq, kind, turn, words, doc_ids, is_new, alive, at): `seq` is the order of arrival in a conversation and `at` its time; `kind`
is `append` or `purge` (a document of the conversation was deleted). Of an append the first of these that holds is the outcome:

- `orphan`: the conversation isn't stored (never begun, purged, or idle for longer than `idle`) and the turn doesn't begin one;
- `dead`: a document of the turn is gone (`alive` is false or null);
- `full`: the conversation holds max_turns turns, or max_words words, by then;
- `late`: its number isn't above those of the turns stored before;
- else `stored`.

A purge's outcome is `purged`, whether anything was stored or not. `turns` and `words` are the conversation's totals after the event.

`store_stream` keeps one small state a conversation, freed by a timer once it is idle; texts never enter the state. `store_batch` gives
the same rows for a finished table by windows over blocks of a conversation, so one that holds most events is spread over its
blocks. Both read words as a number, so that only short rows go anywhere.

Defined results: null kinds count as `append`, null is_new and alive as false, null words and turns as 0; null conv_id is one conversation;
events share no (conv_id, seq), and within a conversation `at` doesn't fall as seq rises; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MAX_TURNS, MAX_WORDS, IDLE_SECONDS = 50, 20_000, 30 * 86_400
#: Events in one block of the batch form: what a window sorts at once.
BLOCK = 4_096
OUTCOMES = "conv_id long, seq long, turn long, outcome string, turns long, words long"
_STATE = "turns long, words long, last long, at long, doc_ids array<long>"


class TurnStore(StatefulProcessor):
    """One conversation's totals, the number of its last turn, when it was last written to, and its documents."""

    def __init__(self, max_turns: int, max_words: int, idle: int) -> None:
        if max_turns < 1 or max_words < 1:
            raise ValueError("a conversation holds a turn and a word at least")
        self.max_turns, self.max_words, self.idle = max_turns, max_words, idle

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("conversation", _STATE)

    def _outcome(self, now: list | None, e) -> tuple[str, list | None]:
        """What becomes of an event, and the conversation after it; now: turns, words, last number, time, documents."""
        if now is not None and e.at - now[3] > self.idle:
            now = None
        if e.kind == "purge":
            return "purged", None
        if now is None and not e.is_new:
            return "orphan", None
        if not e.alive:
            outcome = "dead"
        elif now is not None and (now[0] >= self.max_turns or now[1] >= self.max_words):
            outcome = "full"
        elif now is not None and e.turn <= now[2]:
            outcome = "late"
        else:
            now = now or [0, 0, e.turn, e.at, []]
            return "stored", [now[0] + 1, now[1] + int(e.words), int(e.turn), int(e.at), sorted({*now[4], *map(int, e.doc_ids)})]
        return outcome, now and [*now[:3], int(e.at), now[4]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get() if self.state.exists() else None
        now, out = (list(kept) if kept is not None else None), []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            outcome, now = self._outcome(now, e)
            out.append((key[0], int(e.seq), int(e.turn), outcome, now[0] if now else 0, now[1] if now else 0))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is None:
            self.state.clear()
        else:
            self.state.update((*now[:4], list(now[4])))
            self.handle.registerTimer((now[3] + self.idle + 1) * 1000)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "turn", "outcome", "turns", "words"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()  # no event of the conversation has come since
        yield pd.DataFrame([], columns=["conv_id", "seq", "turn", "outcome", "turns", "words"])

    def close(self) -> None:
        pass


def _plain(events: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    ids = F.filter(F.coalesce(F.col("doc_ids").cast("array<long>"), F.array().cast("array<long>")), lambda x: x.isNotNull()).alias("doc_ids")
    words = F.coalesce(F.col("words").cast("long"), F.lit(0)).alias("words")
    return events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("append")).alias("kind"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), words, ids, flag("is_new"), flag("alive"), F.col("at").cast("timestamp").alias("time"))


def store_stream(events: DataFrame, max_turns: int = MAX_TURNS, max_words: int = MAX_WORDS, idle: int = IDLE_SECONDS, delay: str = "1 hour") -> DataFrame:
    """A streaming table of events -> their outcomes. An event may come up to `delay` after later ones of other conversations.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    rows = _plain(events).withWatermark("time", delay).withColumn("at", F.unix_seconds("time"))
    return rows.groupBy("conv_id").transformWithStateInPandas(TurnStore(max_turns, max_words, idle), OUTCOMES, "Append", "EventTime")


def running(rows: DataFrame, by: list[str], made: dict[str, tuple]) -> DataFrame:
    """rows with running values over what stands before each in its group, in order of seq: new name -> (F.sum or F.max, expression).
    They run inside blocks of a group, and over the totals of the blocks before."""
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "__block").orderBy("seq").rowsBetween(*before)
    blocks = Window.partitionBy(*by).orderBy("__block").rowsBetween(*before)  # one row a block
    totals = rows.groupBy(*by, "__block").agg(*(f(F.expr(c)).alias(f"__of_{n}") for n, (f, c) in made.items()))
    key = [*by, "__block"]
    totals = totals.select(*(F.col(c).alias(f"__key{i}") for i, c in enumerate(key)), *(f(f"__of_{n}").over(blocks).alias(f"__of_{n}") for n, (f, _) in made.items()))
    near = rows.select("*", *(f(F.expr(c)).over(inside).alias(f"__in_{n}") for n, (f, c) in made.items()))
    same = [F.col(c).eqNullSafe(F.col(f"__key{i}")) for i, c in enumerate(key)]
    value = lambda n, f: F.greatest(f"__of_{n}", f"__in_{n}") if f is F.max else F.coalesce(f"__of_{n}", F.lit(0)) + F.coalesce(f"__in_{n}", F.lit(0))
    return near.join(totals, same).select(*rows.columns, *(value(n, f).alias(n) for n, (f, _) in made.items()))


def store_batch(events: DataFrame, max_turns: int = MAX_TURNS, max_words: int = MAX_WORDS, idle: int = IDLE_SECONDS) -> DataFrame:
    """A finished table of events -> their outcomes, as `store_stream`.

    A purge or a long silence ends a life of the conversation; it begins with the first turn that may begin it. Until it is full all its
    eligible turns are stored, and once full it stays so, so whether it is full follows from running totals of the eligible ones.
    """
    rows = _plain(events).withColumns({"at": F.unix_seconds("time"), "__block": F.floor(F.col("seq") / BLOCK)}).drop("time", "doc_ids")
    rows = running(rows, ["conv_id"], {"__at": (F.max, "at")}).withColumn("__quiet", F.coalesce((F.col("at") - F.col("__at") > idle).cast("long"), F.lit(0)))
    rows = running(rows, ["conv_id"], {"__life": (F.sum, "__quiet + cast(kind = 'purge' AS long)")}).withColumn("__life", F.col("__life") + F.col("__quiet"))
    life = ["conv_id", "__life"]
    rows = running(rows.drop("__at", "__quiet"), life, {"__begun": (F.max, "kind <> 'purge' AND is_new AND alive")})
    rows = rows.withColumn("__begun", F.coalesce("__begun", F.lit(False)) | (F.col("is_new") & F.col("alive")))
    rows = running(rows, life, {"__last": (F.max, "CASE WHEN kind <> 'purge' AND alive AND __begun THEN turn END")})
    rows = rows.withColumn("__late", F.coalesce(F.col("turn") <= F.col("__last"), F.lit(False)))
    good = "kind <> 'purge' AND alive AND __begun AND NOT __late"
    rows = running(rows, life, {"__n": (F.sum, f"cast({good} AS long)"), "__w": (F.sum, f"CASE WHEN {good} THEN words ELSE 0 END")})
    full = (F.col("__n") >= max_turns) | (F.col("__w") >= max_words)
    outcome = F.when(F.col("kind") == "purge", "purged").when(~F.col("__begun") & ~F.col("is_new"), "orphan").when(~F.col("alive"), "dead").when(full, "full").when(F.col("__late"), "late").otherwise("stored")
    rows = rows.withColumn("outcome", outcome).withColumn("__kept", (F.col("outcome") == "stored").cast("long"))
    rows = running(rows, life, {"__turns": (F.sum, "__kept"), "__words": (F.sum, "__kept * words")})
    after = lambda total, own: F.when(F.col("kind") == "purge", F.lit(0)).otherwise(F.col(total) + F.col("__kept") * own)
    return rows.select("conv_id", "seq", "turn", "outcome", after("__turns", F.lit(1)).alias("turns"), after("__words", F.col("words")).alias("words"))
