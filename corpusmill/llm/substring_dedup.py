"""Substring deduplication with suffix automata of reference shards.

Every passage of WINDOW words that also starts in a document with a smaller id is removed. The named method sends
each shard's automaton to every document, which is quadratic in the corpus; here shards are cut by content, so that
a passage can only match inside one shard, and each document's passages go to that shard's automaton alone:

1. One row of each group of equal texts goes on; the others repeat it entirely.
2. Each window has an anchor, the least hash of its ANCHOR-word runs. A first pass counts in how many documents anchors
   stand; each task keeps back those it has seen seldom (in under SELDOM documents, or its part of HOT_ANCHOR if that is more), so
   only counts of frequent ones are shuffled. Anchors in more than HOT_ANCHOR documents by these counts, however many there
   are, are hot from the start: a bitmap of bounded size tells them, and one it takes for hot by mistake is treated alike
   everywhere. Their marks never meet, so an anchor's marks that do meet number 2 HOT_ANCHOR, or SELDOM a task, at most: some
   megabytes. The other anchors seen in two documents are found by a shuffle of four-byte marks; a window whose anchor
   is unique repeats nowhere.
3. The other windows are cut into segments of consecutive windows with one anchor. Equal segments are combined before
   the shuffle; a shard is a bucket of anchors. Windows of a hot anchor are dealt one by one by their content
   instead, so that a common phrase in varied contexts spreads over all shards.
4. In a shard, segments stream through a growing suffix automaton in the order of their smallest id: the matching
   statistics give each window the smallest id that has it; then the segment is added.
5. Segments' results join back to where they stand; words under a window that a smaller id has are dropped.

Exactness: words are told apart by 48-bit hashes inside segments of 13 or more, so two different windows are taken as
equal only if a changed word collides (about 4e-15 for each near match).

Defined results: null or empty text has no words; a null id repeats nothing and is repeated by nothing; rows with one
id are one document (they never remove each other's words); a document shorter than the window keeps all words; an
empty table gives no rows. The longest text must fit a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap
from .storage import bucket_count, written
from .text import blocks, expanded, mix, ranges, span_hashes, split_words, squeezed, window_hashes

WINDOW, ANCHOR = 13, 6
HOT_ANCHOR, SELDOM = 5_000, 8
SHARD_BYTES = 4 << 20
_WORD = 6
_LOW = np.uint64(0xFFFFFFFF)


def _anchors(words: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie in one row: start, row, place of the anchor; and the hash of the run at each place."""
    counts = np.maximum(np.diff(first) - window + 1, 0)
    starts = ranges(first[:-1], counts)
    runs = window_hashes(words, anchor)
    best, at = runs[starts] if len(starts) else runs[:0], starts.copy()
    for j in range(1, window - anchor + 1):
        other = runs[starts + j] if len(starts) else runs[:0]
        less = other < best
        best = np.where(less, other, best)
        at[less] = starts[less] + j
    return starts, np.repeat(np.arange(len(counts)), counts), at, runs


def _frequent_batches(window: int, anchor: int, seldom: int, most: int = 1 << 21):
    """Texts -> anchors (32 bits) with the number of the task's documents that have them, from `seldom` documents on."""

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        limit = most
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(batch.schema.get_field_index("text"))):
                starts, ends, first = split_words(data, offsets)
                _, of, at, runs = _anchors(span_hashes(data, starts, ends), first, window, anchor)
                new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
                pairs = np.sort(runs[at[new]].astype(np.uint32).astype(np.uint64) << np.uint64(32) | of[new].astype(np.uint64))
                pairs = pairs[np.diff(pairs, prepend=~pairs[:1]) != 0] >> np.uint64(32)
                keys, counts = np.unique(pairs, return_counts=True)
                parts.append((keys, counts))
            if sum(len(k) for k, _ in parts) > limit:
                parts = [added(parts)]
                limit = max(most, 2 * len(parts[0][0]))  # so that a key is merged a few times at most
        keys, counts = added(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = counts >= seldom
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].astype(np.int64)), pa.array(counts[keep])], names=["anchor", "n"])

    return run


def hot_anchors(texts: DataFrame, window: int, anchor: int, hot: int, seldom: int = SELDOM) -> Bitmap:
    """Anchors (32 bits) in more than `hot` documents by the counts that tasks don't keep back."""
    tasks = texts.rdd.getNumPartitions()
    counted = texts.select("text").mapInArrow(_frequent_batches(window, anchor, hot // tasks if hot > tasks * seldom else min(seldom, hot)), "anchor long, n long")
    return Bitmap.of(written(counted.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > hot), "hot"), "anchor")


def _mark_batches(window: int, anchor: int, buckets: int, hot):
    """Per block and bucket one row of packed marks: documents, then hash, document and place of each anchor that isn't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in expanded(batches):
            ids, keys = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "k"))
            for row, n, data, offsets in blocks(batch.column(batch.schema.get_field_index("text"))):
                starts, ends, first = split_words(data, offsets)
                _, of, at, runs = _anchors(span_hashes(data, starts, ends), first, window, anchor)
                new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
                new = new[~hot.value.has(runs[at[new]] & _LOW)]
                if not len(new):
                    continue
                of, at = of[new], at[new]
                hashes = runs[at]
                bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                out_b, out_d = [], []
                for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    part = order[lo:hi]
                    docs, index = np.unique(of[part], return_inverse=True)
                    place = (at[part] - first[of[part]]).astype(np.int32)
                    head = np.array([len(docs), len(part)], np.int64)
                    out_b.append(bucket[part[0]])
                    out_d.append(b"".join(x.tobytes() for x in (head, ids[row + docs], keys[row + docs], hashes[part].astype(np.uint32), np.diff(index, prepend=0).astype(np.int32), np.diff(place, prepend=0).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_d, pa.binary())], names=["bucket", "marks"])

    return run


def _repeated():
    """Marks of one bucket -> places whose anchor two documents have."""

    def run(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        base = 0
        for raw in table.column("marks").to_pylist():
            d, n = map(int, np.frombuffer(raw, np.int64, 2))
            at = 16
            for k, (kind, size) in enumerate(((np.int64, d), (np.int64, d), (np.uint32, n), (np.int32, n), (np.int32, n))):
                x = np.frombuffer(raw, kind, size, at)
                at += x.nbytes
                parts[k].append(x if k < 3 else np.cumsum(x) + (base if k == 3 else 0))
            base += d
        ids, keys, hashes, docs, places = (np.concatenate(x) for x in parts)
        order = np.lexsort((docs, hashes))
        h, d = hashes[order], docs[order]
        heads = np.flatnonzero(np.diff(h, prepend=h[0] ^ np.uint32(1)) != 0)
        group = np.cumsum(np.isin(np.arange(len(h)), heads, assume_unique=True)) - 1
        fresh = np.diff(d, prepend=-1) != 0
        fresh[heads] = True
        many = np.bincount(group, fresh)
        keep = many[group] > 1
        row, place = order[keep], places[order[keep]]
        return pa.table({"id": ids[docs[row]], "k": keys[docs[row]], "place": place.astype(np.int32)})

    return run


_SEGMENT = "c1 long, c2 long, id long, k long, start int, shard int, words binary"


def _segment_batches(window: int, anchor: int, shards: int, often):
    """Texts with their repeated places -> segments; `words` is set only for the first of equal segments in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in expanded(batches):
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            ids, keys, places = col("id").to_numpy(), col("k").to_numpy(), col("places")
            for row, n, data, offsets in blocks(col("text")):
                starts, ends, first = split_words(data, offsets)
                words = span_hashes(data, starts, ends)
                win, of, at, runs = _anchors(words, first, window, anchor)
                state = np.zeros(len(words) + 1, np.int8)
                part = pc.fill_null(places.slice(row, n), [])
                flat = part.flatten().to_numpy().astype(np.int64)
                base = np.repeat(first[:-1], np.diff(part.offsets.to_numpy()) if n else 0)
                state[base + flat] = 1
                state[np.flatnonzero(often.value.has(runs & _LOW))] = 2
                chosen = np.flatnonzero(state[at] > 0)
                if not len(chosen):
                    continue
                w, a, hot = win[chosen], at[chosen], state[at[chosen]] == 2
                cut = (np.diff(a, prepend=-1) != 0) | hot
                cut[1:] |= np.diff(w) != 1
                lo = np.flatnonzero(cut)
                count = np.diff(lo, append=len(w))
                begin, size, hot = w[lo], count + window - 1, hot[lo]
                span = ranges(begin, size)
                symbols = words[span] >> np.uint64(16)
                edges = np.concatenate([[0], np.cumsum(size)])
                value = np.cumsum(np.concatenate([[np.uint64(0)], mix(symbols ^ (np.arange(len(span), dtype=np.uint64) - np.repeat(edges[:-1], size).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))]), dtype=np.uint64)
                c1 = mix(value[edges[1:]] - value[edges[:-1]] + size.astype(np.uint64))
                value = np.cumsum(np.concatenate([[np.uint64(0)], mix(mix(symbols + np.uint64(77)) + (np.arange(len(span), dtype=np.uint64) - np.repeat(edges[:-1], size).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))]), dtype=np.uint64)
                c2 = mix(value[edges[1:]] - value[edges[:-1]])
                route = np.where(hot, c1, runs[a[lo]])
                shard = ((mix(route) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
                row_of = of[chosen[lo]]
                id_ = ids[row + row_of]
                _, lead = np.unique(c1[np.argsort(id_, kind="stable")], return_index=True)
                lead = set(np.argsort(id_, kind="stable")[lead].tolist())
                packed = symbols.view(np.uint8).reshape(-1, 8)[:, :_WORD].tobytes()
                texts = [packed[edges[i] * _WORD : edges[i + 1] * _WORD] if i in lead else None for i in range(len(lo))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(id_), pa.array(keys[row + row_of]), pa.array((begin - first[row_of]).astype(np.int32)), pa.array(shard), pa.array(texts, pa.binary())],
                    names=["c1", "c2", "id", "k", "start", "shard", "words"],
                )

    return run


class Automaton:
    """Suffix automaton of several sequences; each state knows the owner under which its strings were first added."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.owner = [-1], [0], [0]

    def _state(self, size: int, owner: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.owner.append(owner)
        return len(self.size) - 1

    def add(self, symbols: list[int], owner: int) -> None:
        edges, link, size = self.next, self.link, self.size
        p = 0
        for c in symbols:
            q = edges[p].get(c)
            if q is not None and size[q] == size[p] + 1:
                p = q
                continue
            new = self._state(size[p] + 1, owner, 0, {}) if q is None else -1
            v = p
            if q is None:
                while v >= 0 and c not in edges[v]:
                    edges[v][c] = new
                    v = link[v]
                if v < 0:
                    p = new
                    continue
                q = edges[v][c]
                if size[q] == size[v] + 1:
                    link[new] = q
                    p = new
                    continue
            copy = self._state(size[v] + 1, self.owner[q], link[q], edges[q].copy())
            while v >= 0 and edges[v].get(c) == q:
                edges[v][c] = copy
                v = link[v]
            link[q] = copy
            if new >= 0:
                link[new] = copy
                p = new
            else:
                p = copy

    def owners(self, symbols: list[int], window: int) -> list[int | None]:
        """For each window of `symbols`, the first owner that has it, or None: the matching statistics cut at `window`."""
        edges, link, size, owner = self.next, self.link, self.size, self.owner
        out: list[int | None] = []
        v = matched = 0
        for i, c in enumerate(symbols):
            while v and c not in edges[v]:
                v = link[v]
                matched = size[v]
            if c in edges[v]:
                v = edges[v][c]
                matched += 1
            if matched >= window:
                while size[link[v]] >= window:
                    v = link[v]
                matched = window
            if i >= window - 1:
                out.append(owner[v] if matched >= window else None)
        return out


def _shard_owners(window: int):
    """Distinct segments of one shard -> for each window of a segment the smallest id that has it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("c1", "ascending"), ("c2", "ascending")])
        c1, c2, ids, many = (table.column(c).to_pylist() for c in ("c1", "c2", "id", "many"))
        raw = table.column("words").to_pylist()
        sizes = np.array([len(x) // _WORD for x in raw], np.int64)
        symbols = np.zeros((int(sizes.sum()), 8), np.uint8)
        symbols[:, :_WORD] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, _WORD)
        flat = symbols.view(np.uint64).ravel()
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = ranges(first[:-1], sizes - window + 1)
        _, inverse, times = np.unique(window_hashes(mix(flat), window)[at], return_inverse=True, return_counts=True)
        shared = np.bincount(np.repeat(np.arange(len(sizes)), sizes - window + 1), times[inverse] > 1, len(sizes)) > 0
        automaton, found, waiting = Automaton(), [], []
        out: list[int] = []
        owner_now = None
        for i, own in enumerate(ids):
            if not shared[i]:
                if many[i] > 1:
                    out.append(i)
                    found.append([own] * int(sizes[i] - window + 1))
                continue
            if own != owner_now:
                for s in waiting:
                    automaton.add(s, owner_now)
                waiting, owner_now = [], own
            seq = flat[first[i] : first[i + 1]].tolist()
            have = automaton.owners(seq, window)
            if None in have:
                waiting.append(seq)
            if many[i] > 1 or any(x is not None for x in have):
                out.append(i)
                found.append([own if x is None else x for x in have])
        return pa.table({"c1": pa.array([c1[i] for i in out], pa.int64()), "c2": pa.array([c2[i] for i in out], pa.int64()), "owners": pa.array(found, pa.list_(pa.int64()))})

    return run


def _final_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in expanded(batches):
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            text, copy, spans = col("text"), col("copied").to_pylist(), col("spans").to_pylist()
            n_words, n_removed, kept = [], [], []
            for row, n, data, offsets in blocks(text):
                starts, ends, first = split_words(data, offsets)
                whole = data.tobytes()
                for i in range(n):
                    lo, hi = int(first[i]), int(first[i + 1])
                    gone = np.zeros(hi - lo + 1, np.int32)
                    if copy[row + i] and hi - lo >= window:
                        gone[0] = 1
                    for s in spans[row + i] or ():
                        for j, covered in enumerate(s["mask"]):
                            if covered == "1":
                                gone[s["start"] + j] += 1
                                gone[s["start"] + j + window] -= 1
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + lo
                    n_words.append(hi - lo)
                    n_removed.append(hi - lo - len(stay))
                    kept.append(b" ".join([whole[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([col("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT_ANCHOR) -> DataFrame:
    """(id, n_words, n_removed, kept_text) for every row of docs: its words without those of windows that a smaller id has."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = bucket_count(size, SHARD_BYTES)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text).withColumn("k", F.xxhash64("text"))
    rows = plain.mapInArrow(squeezed, "id long, k long, z binary")
    lead = plain.where("id IS NOT NULL").groupBy("k", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.min("id").alias("id")).select("id", "k")
    once = rows.join(lead.hint("shuffle_hash"), ["id", "k"])
    often = docs.sparkSession.sparkContext.broadcast(hot_anchors(plain, window, anchor, hot))
    marks = once.select("id", "k", "z").mapInArrow(_mark_batches(window, anchor, shards, often), "bucket long, marks binary")
    places = marks.groupBy("bucket").applyInArrow(_repeated(), "id long, k long, place int").groupBy("id", "k").agg(F.collect_list("place").alias("places"))
    placed = once.join(places.hint("shuffle_hash"), ["id", "k"], "left" if often.value else "inner").select("id", "k", "z", "places")
    segments = written(placed.mapInArrow(_segment_batches(window, anchor, shards, often), _SEGMENT), "segments")
    content = segments.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("many"))
    words = segments.where("words IS NOT NULL").groupBy("shard", "c1", "c2", "words").agg(F.min("id").alias("id"))
    owners = words.drop("id").join(content, ["c1", "c2"]).groupBy("shard").applyInArrow(_shard_owners(window), "c1 long, c2 long, owners array<long>")
    spans = (
        segments.select("c1", "c2", "id", "k", "start").join(owners, ["c1", "c2"])
        .select("id", "k", "start", F.expr("array_join(transform(owners, o -> if(o < id, '1', '0')), '')").alias("mask")).where("mask LIKE '%1%'")
        .groupBy("id", "k").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))
    )
    found = lead.withColumn("lead", F.lit(True)).join(spans, ["id", "k"], "left")
    out = rows.join(found.hint("shuffle_hash"), ["id", "k"], "left").select("id", "z", F.expr("lead IS NULL AND id IS NOT NULL").alias("copied"), "spans")
    return out.mapInArrow(_final_batches(window), "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


_DUCK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Words hold no space, so thirteen joined by spaces are one key.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_DUCK_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM starts),
least AS (SELECT k, min(doc_id) AS owner FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM windows JOIN least USING (k) WHERE owner < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same by one dictionary of windows; for tests on small inputs."""
    import re

    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in split:
        for j in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[j : j + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
