"""The training-data operators: brute force, exact round trips, held-out accuracy, and awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import bitmap, exact_dedup, graph, license_scan, media, mixing, ngram_join, packing, quality, queries, sharding, storage, substring_dedup, toxicity
from corpusmill.llm.graph import components
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, shard string, id string"


def docs_of(spark, rows):
    """rows (doc_id, text) with the other columns, null in places, and columns whose names clash with outputs."""
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s1", 0, 9.0, "x", "y", "z") for k, (i, t) in enumerate(rows)], SCHEMA)


LONG = " ".join(f"w{i % 977}" for i in range(60_000))
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (5, "a  b"), (None, "a b"), (None, None), (6, LONG), (7, LONG), (8, "ß → 漢字 \x00 end"), (9, "a b c d e f g h i j k l m n o p")]


@pytest.fixture(params=[AWKWARD, []], ids=["awkward", "empty"])
def docs(request, spark):
    return docs_of(spark, request.param)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name], SF) == []


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 30_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        f = exact_dedup.build_filter(keys)
        assert exact_dedup.in_filter(f, keys).all()
        assert exact_dedup.in_filter(f, rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.01


def test_dedup_awkward(spark, docs):
    rows = docs.collect()
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    want = sorted(((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {w[1] for w in want}


def test_dedup_drops_rows_not_ids(spark):
    rows = [(1, "a b"), (None, "a b"), (None, "only here"), (None, "twice"), (None, "twice"), (7, "a b"), (7, "other text"), (8, "other text")]
    left = [(r.doc_id, r.text) for r in exact_dedup.drop_copies(docs_of(spark, rows)).collect()]
    assert sorted(left, key=str) == sorted([(1, "a b"), (None, "only here"), (None, "twice"), (None, "twice"), (7, "other text")], key=str)


def test_saved_filters_screen_a_second_batch(spark, tmp_path):
    path = str(tmp_path)
    first, second = [(10, "a b"), (11, "a  b"), (12, "c"), (None, "only null")], [(5, "d"), (6, None), (4, "c")] + [(1000 + i, f"text {i}") for i in range(500)]
    exact_dedup.write_snapshot(docs_of(spark, first), path, 1, 4)
    exact_dedup.write_snapshot(docs_of(spark, second), path, 2, 4)
    batch = [(90, "a\tb"), (91, "new"), (92, "new"), (93, "c"), (94, ""), (95, "text 499"), (None, "new"), (96, "only null"), (97, "else")]
    got = {r.doc_id: (r.known_id, r.keep_id) for r in exact_dedup.screen_batch(docs_of(spark, batch), path).collect()}
    assert got == {90: (10, 10), 91: (None, 91), 92: (None, 91), 93: (4, 4), 94: (6, 6), 95: (1499, 1499), None: (None, 91), 96: (None, 96), 97: (None, 97)}
    exact_dedup.write_snapshot(docs_of(spark, batch), path, 3, 4)  # the batch is a snapshot for those that follow
    assert [tuple(r)[2:] for r in exact_dedup.screen_batch(docs_of(spark, [(7, "new")]), path).collect()] == [(91, 91)]
    assert exact_dedup.screen_batch(docs_of(spark, []), path).count() == 0


def test_dedup_of_ids_far_apart(spark):
    rows = [(-(2**63), "a  b"), (2**63 - 1, "a b"), (0, "c"), (None, "c"), (2**62, "c")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(-(2**63), -(2**63), 2), (2**63 - 1, -(2**63), 2), (0, 0, 3), (None, 0, 3), (2**62, 0, 3)], key=str)


@pytest.mark.parametrize("edges_at_once", [graph.EDGES, 40])
def test_components(spark, monkeypatch, edges_at_once):
    monkeypatch.setattr(graph, "EDGES", edges_at_once)
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5), (None, 3)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in top}


def jaccard_truth(rows):
    sets, lead = {}, {}
    for i, t in rows:
        w = tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        lead.setdefault(w, []).append(i)
        sets[w] = {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())
    links = {a: [b for b in sets if b != a and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9] for a in sets}
    return lead, links


@pytest.mark.parametrize("block", [1024, 13])
def test_ngram_join_brute_force(spark, block):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(x if rng.random() > 0.012 else f"q{rng.randint(0, 30)}" for x in base)) for i in range(100)] + [(300 + i, f"only here {i} and {i * 7} there so {i}") for i in range(20)]
    got = {r.doc_id: r for r in ngram_join.similar_documents(docs_of(spark, rows), block=block, sample=40 if block == 13 else 1000, split_from=block).collect()}
    lead, links = jaccard_truth(rows)
    for words, ids in lead.items():
        seen, edge = {words}, [words]
        while edge:
            new = [x for x in links[edge.pop()] if x not in seen]
            seen.update(new)
            edge += new
        for i in ids:
            assert (got[i].copy_of, got[i].n_links, got[i].class_id) == (min(ids), len(links[words]), min(min(lead[w]) for w in seen))


def test_connected_parts_of_a_matrix():
    rng = np.random.default_rng(3)
    for share in (0, 0.01, 0.05, 0.5, 1):
        hit = rng.random((40, 30)) < share
        got = sorted((tuple(sorted(r.tolist())), tuple(sorted(c.tolist()))) for r, c in ngram_join.connected(hit))
        left, want = {(0, i) for i in np.flatnonzero(hit.any(1)).tolist()}, []
        while left:
            part, edge = set(), [left.pop()]
            while edge:
                kind, i = edge.pop()
                if (kind, i) not in part:
                    part.add((kind, i))
                    edge += [(1, int(j)) for j in np.flatnonzero(hit[i])] if kind == 0 else [(0, int(j)) for j in np.flatnonzero(hit[:, i])]
            left -= part
            want.append((tuple(sorted(i for k, i in part if k == 0)), tuple(sorted(i for k, i in part if k == 1))))
        assert got == sorted(want)


def test_ngram_join_awkward(spark, docs):
    out = ngram_join.similar_documents(docs)
    assert out.count() == docs.count()
    got = {r.doc_id: (r.copy_of, r.class_id, r.n_links) for r in out.where("doc_id IS NOT NULL").collect()}
    if got:
        assert got[2] == got[3] == got[1] == (1, 1, 0) and got[5] == (4, 4, 0) and got[7] == (6, 6, 0)
    assert ngram_join.drop_near_copies(docs).columns == docs.columns


def test_ngram_join_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (None, a), (None, a + " more"), (None, b), (None, b + " more"), (None, "only here"), (7, c + " more"), (7, "another text"), (3, c), (9, "another text")]
    out = ngram_join.similar_documents(docs_of(spark, rows)).collect()
    got = sorted(((r.doc_id, r.copy_of, r.class_id, r.n_links) for r in out), key=str)
    want = [(1, 1, 1, 1), (None, 1, 1, 1), (None, None, 1, 1), (None, None, None, 1), (None, None, None, 1), (None, None, None, 0), (7, 7, 3, 1), (7, 7, 7, 0), (3, 3, 3, 1), (9, 7, 7, 0)]
    assert got == sorted(want, key=str)
    left = [(r.doc_id, r.text) for r in ngram_join.drop_near_copies(docs_of(spark, rows)).collect()]
    assert sum(t in (b, b + " more") for _, t in left) == 1
    assert sorted((x for x in left if not x[1].startswith("b0 ")), key=str) == sorted([(1, a), (None, "only here"), (7, "another text"), (3, c)], key=str)


def test_match_depth_follows_what_was_measured():
    assert ngram_join.match_depth({}) == max(d for d in range(1, ngram_join.DEPTH + 1) if ngram_join.found_share(0.8, d) >= ngram_join.TARGET_RECALL)
    assert ngram_join.match_depth({97: 10**6}) == ngram_join.DEPTH
    depths = [ngram_join.match_depth({80: n, 97: 10**6}) for n in (0, 1000, 10**5, 10**7)]
    assert depths == sorted(depths, reverse=True) and depths[-1] < depths[0]
    for pairs in ({}, {80: 5}, {80: 10**4, 95: 10**4}):
        assert ngram_join.recall_at(pairs, ngram_join.match_depth(pairs)) >= ngram_join.TARGET_RECALL


def one_faint_pair():
    """150 pairs that differ in one word, and one pair at 0.806 whose signatures share no whole path in any tree."""
    rng = random.Random(6)
    text = lambda: [f"v{rng.randrange(10**9)}" for _ in range(60)]
    faint = [(t, [*t[:30], "else", *t[31:59], "end"]) for t in (text() for _ in range(1500))]
    column = pa.array([" ".join(t) for pair in faint for t in pair])
    none = pa.array(range(len(column)), pa.int64())
    signed = pa.concat_arrays([b.column(5) for b in ngram_join._signature_batches(iter([pa.RecordBatch.from_arrays([none, none, none, column], ["id", "d1", "d2", "text"])]))])
    paths = np.frombuffer(b"".join(signed.to_pylist()), ">u4").reshape(-1, 2, ngram_join.TREES, ngram_join.DEPTH)
    i = int(np.flatnonzero(~(paths[:, 0] == paths[:, 1]).all(2).any(1))[0])
    alike = [(10 + 2 * k + j, " ".join(t + ["more"] * j)) for k, t in enumerate(text() for _ in range(150)) for j in (0, 1)]
    return [(j, " ".join(t)) for j, t in enumerate(faint[i])] + alike


def test_ngram_join_finds_a_faint_pair_among_many_close_ones(spark, monkeypatch):
    rows, seen, shortened = one_faint_pair(), [], getattr(ngram_join, "shortened", None)
    monkeypatch.setattr(ngram_join, "shortened", lambda pairs, depth: seen.append(pairs) or shortened(pairs, depth), raising=False)
    for sizes in ({}, {"block": 32, "split_from": 64, "sample": 40}):
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_documents(docs_of(spark, rows), **sizes).collect()}
        assert got[0] == got[1] == (0, 1) and {x[1] for x in got.values()} == {1}
        assert seen.pop() == {80: 1, 98: 150}  # every link is counted


def test_pipeline_stage_drops_a_faint_copy(spark):
    left = {r.doc_id for r in corpus_pipeline.dissimilar(spark, docs_of(spark, one_faint_pair()), SF).collect()}
    assert left == {0} | {10 + 2 * k for k in range(150)}


def test_pipeline_stage_takes_the_prefix_from_no_sample(spark, monkeypatch):
    """The first prefix sees no counts of the table; what may shorten it are all links, as many as brute force has."""
    rng, base, given, seen = random.Random(2), [f"w{i}" for i in range(60)], [], []
    rows = [(i, " ".join(x if rng.random() > 0.012 else f"q{rng.randint(0, 30)}" for x in base)) for i in range(100)]
    first, shortened = ngram_join.match_depth, getattr(ngram_join, "shortened", None)
    monkeypatch.setattr(ngram_join, "match_depth", lambda pairs, **k: given.append(dict(pairs)) or first(pairs, **k))
    monkeypatch.setattr(ngram_join, "shortened", lambda pairs, depth: seen.append(dict(pairs)) or shortened(pairs, depth), raising=False)
    left = {r.doc_id for r in corpus_pipeline.dissimilar(spark, docs_of(spark, rows), SF).collect()}
    lead, links = jaccard_truth(rows)
    runs = {a: {a[k : k + 5] for k in range(len(a) - 4)} for a in lead}
    want = {}
    for a, b in ((a, b) for a in links for b in links[a] if a < b):
        near = 100 * len(runs[a] & runs[b]) // len(runs[a] | runs[b])
        want[near] = want.get(near, 0) + 1
    assert given == [{}] and seen == [want]
    group = {w: min(ids) for w, ids in lead.items()}
    while (now := {a: min([group[a], *(group[b] for b in links[a])]) for a in group}) != group:
        group = now
    assert left == set(group.values())


def test_ngram_join_counts_all_links_of_split_groups(spark, monkeypatch):
    rng, base, seen = random.Random(2), [f"w{i}" for i in range(60)], []
    rows = [(i, " ".join(x if rng.random() > 0.012 else f"q{rng.randint(0, 30)}" for x in base)) for i in range(100)]
    monkeypatch.setattr(ngram_join, "shortened", lambda pairs, depth: seen.append(pairs) or ngram_join.LEAST_DEPTH, raising=False)
    got = ngram_join.similar_documents(docs_of(spark, rows), block=13).collect()
    _, links = jaccard_truth(rows)
    lead = {r.doc_id: r.n_links for r in got if r.doc_id == r.copy_of}
    assert sum(seen[0].values()) * 2 == sum(map(len, links.values())) == sum(lead.values())  # before and after shortening


def test_prefix_is_shortened_by_all_links():
    start = ngram_join.match_depth({})
    assert ngram_join.shortened({}, start) == ngram_join.shortened({80: 100, 97: 10**9}, start) == start
    depths = [ngram_join.shortened({80: n}, start) for n in (1000, 10**5, 10**9)]
    assert depths == sorted(depths, reverse=True) and depths[0] == start and depths[1] < start and depths[-1] == ngram_join.LEAST_DEPTH


def test_split_large_parts_no_similar_pair(spark):
    """A family that shares half of its words parts into singles; near copies in it stay together."""
    shared, rng = [f"s{i}" for i in range(40)], random.Random(8)
    texts = [" ".join(shared + [f"{k}x{i}" for i in range(40)]) for k in range(30)]
    texts += [t.replace("x39", "x39 more") for t in texts[:5]] + [" ".join(x if rng.random() > 0.03 else "q" for x in texts[7].split()) for _ in range(4)]
    sets = [(i, 1, {hash(tuple(t.split()[k : k + 5])) for k in range(len(t.split()) - 4)}) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, c, bytearray(np.array(sorted(s), np.int64).tobytes())) for i, c, s in sets], "id long, component long, shingles binary")
    group = {r.id: r.component for r in ngram_join.split_large(df).collect()}
    for i, _, a in sets:
        for j, _, b in sets:
            if i < j and len(a & b) >= 0.8 * len(a | b):
                assert group[i] == group[j]
    assert len(group) < 20


def random_texts(seed):
    rng = random.Random(seed)
    few = ["aa", "bb", "cc", "dd"]
    rows = [(i // 2 if i % 7 else None, " ".join(rng.choice(few) for _ in range(rng.choice([0, 5, 13, 40, 90])))) for i in range(60)]
    base = [f"w{i}" for i in range(60)]
    return rows + [(100 + i, " ".join(base[: rng.randint(0, 60)] + [f"z{i}"] + base[rng.randint(0, 50) :])) for i in range(60)] + [(100 + i % 3, " ".join(base)) for i in range(5)] + AWKWARD


@pytest.mark.parametrize("hot", [5000, 3])
def test_substring_dedup_brute_force(spark, hot):
    rows = random_texts(hot)
    got = substring_dedup.remove_repeats(docs_of(spark, rows), hot=hot).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(substring_dedup.brute_force(rows), key=str)


def test_substring_dedup_with_more_hot_anchors_than_bits(spark, monkeypatch):
    """Every anchor is hot or taken for hot: results are the same, whatever the bitmap's size."""
    monkeypatch.setattr(bitmap, "LEAST_BITS", 64)
    monkeypatch.setattr(bitmap, "MOST_BITS", 64)
    rows = random_texts(11)
    often = substring_dedup.hot_anchors(docs_of(spark, rows).select("text").fillna(""), 13, 6, 1, 1)
    assert often and often.has(np.random.default_rng(1).integers(0, 2**32, 500)).mean() > 0.9
    got = substring_dedup.remove_repeats(docs_of(spark, rows), hot=1).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(substring_dedup.brute_force(rows), key=str)


def test_substring_dedup_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, substring_dedup.query(spark, SF).collect())) == sorted(substring_dedup.brute_force(rows))
    assert substring_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_automaton_matches_all_substrings():
    rng = random.Random(9)
    for _ in range(50):
        a, first = substring_dedup.Automaton(), {}
        for owner in range(6):
            seq = [rng.randrange(3) for _ in range(rng.randint(3, 20))]
            want = [first.get(tuple(seq[i : i + 3])) for i in range(len(seq) - 2)]
            assert a.owners(seq, 3) == want
            a.add(seq, owner)
            for i in range(len(seq) - 2):
                first.setdefault(tuple(seq[i : i + 3]), owner)


def test_media_round_trip():
    for n in [*range(0, 400), 32_767, 32_768, 32_769, 70_000]:
        p = random.Random(n).randbytes(n)
        r = media.parse_stream(media.mux(p))
        assert r["payload"] == p and not r["gaps"] and not r["repeats"] and len(r["pts"]) == len(r["random_access"]) == -(-n // media.PES_BYTES)


def test_media_damage():
    good = media.mux(b"x" * 5000)
    assert media.parse_stream(good[: 188 * 5] + good[188 * 6 :])["gaps"] == 1
    assert media.parse_stream(good[: 188 * 6] + good[188 * 5 :])["repeats"] == 1 and media.parse_stream(good[: 188 * 6] + good[188 * 5 :])["payload"] == b"x" * 5000
    assert media.parse_stream(None)["payload"] == b"" and media.parse_stream(b"junk" * 100)["programs"] == []
    assert media.parse_stream(good + b"tail")["lost_bytes"] == 4


def foreign_stream(table_bytes: int = 400) -> bytes:
    """A stream as another writer makes it: long tables over several packets, two streams, announced and other gaps, stuffing."""

    def packet(pid, count, body, begin=False, field=b""):
        field = bytes([len(field)]) + field if field else b""
        room = 184 - len(field) - len(body)
        if room:
            field = (field or b"\0") + b"\xff" * room if field else (bytes([room - 1]) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b""))
            field = bytes([len(field) - 1]) + field[1:]
        return bytes([0x47, 0x40 * begin | pid >> 8, pid & 255, (0x30 if field else 0x10) | count % 16]) + field + body

    def table(pid, table_id, ident, body):
        raw = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
        raw = b"\0" + raw + media.table_crc(raw).to_bytes(4, "big")
        return [packet(pid, i, raw[184 * i : 184 * i + 184], i == 0) for i in range(-(-len(raw) // 184))]

    pat = b"".join(bytes([0, k, 0xE0 | 0x20, k]) for k in range(1, table_bytes // 4))
    info = bytes([0x80, 200]) + b"d" * 200
    pmt = bytes([0xE0 | 1, 1, 0xF0, len(info)]) + info + bytes([2, 0xE1, 1, 0xF0, 0, 6, 0xE1, 2, 0xF0, 0])
    pes = lambda n, body: b"\0\0\1\xbd" + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + media._pts_bytes(n) + body
    out = [*table(0, 0, 1, pat), *table(0x2001 & 0x1FFF, 2, 1, pmt)]
    a, b, c = (pes(90_000 * k, bytes([64 + k]) * 300) for k in range(3))
    cut = lambda raw, at, skip=0: [packet(0x102, at + i + (skip if i else 0), raw[184 * i : 184 * i + 184], i == 0) for i in range(-(-len(raw) // 184))]
    out += cut(a, 3) + [packet(0x102, 9, b[:170], True, b"\x80")] + [packet(0x102, 10, b[170:])] + cut(c, 11, 2)
    return b"".join(out)


def test_media_reads_another_writers_stream():
    data = foreign_stream()
    assert len(data) % 188 == 0
    r = media.parse_stream(data)
    assert len(r["programs"]) == 99 and (1, 0x101, 2) in r["streams"] and (1, 0x102, 6) in r["streams"]
    assert (r["gaps"], r["damaged"], r["repeats"]) == (1, 1, 0) and r["pts"] == [0, 90_000, 180_000]
    assert r["payload"] == b"@" * 300 + b"A" * 300 + b"B" * 300


def test_media_columns_awkward(spark, docs):
    df = docs.withColumn("media", F.lit("old")).withColumn("parsed", F.lit(1)).withColumn("raw", F.encode("text", "utf-8"))
    out = media.read_media(media.store_as_media(df, "raw"))
    assert sorted(out.columns) == sorted(df.columns) and out.count() == docs.count()
    assert all(bytes(r.parsed.payload) == (r.text or "").encode() and r.parsed.damaged == 0 for r in out.collect())


def test_media_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in media.query(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")  # up to a positive multiple of 64
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) and r.media_sha256 == hashlib.sha256(media.mux(p)).hexdigest()


def check_pieces(spark, rows, pieces):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = sorted((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, want in ids:
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes()) and p.doc_tokens == len(want)
            at += p.length
        assert at == len(want)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
    assert sorted(by_seq) == list(range(len(by_seq)))
    return by_seq


def test_packing(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    seqs = check_pieces(spark, rows, packing.query(spark, SF).collect())
    used = sum(p.length for s in seqs.values() for p in s)
    assert used / (len(seqs) * packing.CAPACITY) > 0.97


def test_packing_awkward(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (None, 4)]
    check_pieces(spark, rows, packing.pack(docs.where("doc_id <> 4"), "doc_id").collect())
    whole = packing.pack(docs, with_ids=True)
    assert whole.count() >= docs.count() and whole.where("crc32(ids) <> ids_crc32").count() == 0


def test_words_are_coded_once_over_tasks(monkeypatch):
    """A worker's next task, and a word among many rare ones, find their words in the cache."""
    learned, learn = [], packing.Coder.learn
    monkeypatch.setattr(packing.Coder, "learn", lambda self, *a: learned.extend(a[-1]) or learn(self, *a))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    packing._coder.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two three", "Two, four"])], names=["id", "text"])
    tasks = [[b.to_pylist() for b in packing._piece_batches(packing.tokenizer_path(), packing.CAPACITY, 1, False)(iter([batch]))] for _ in range(2)]
    assert tasks[0] == tasks[1] and sum(w in (b"two", "two") for w in learned) == 1
    packing._coder.cache_clear()
    monkeypatch.setattr(packing.Coder, "SLOTS", 1 << 12, raising=False)
    monkeypatch.setattr(packing.Coder, "MOST", 1 << 9, raising=False)
    coder = packing.Coder(packing.tokenizer_path())
    learned.clear()
    for i in range(300):
        coder.code([f"often again {''.join(chr(97 + i // 26**k % 26) for k in range(3))}q"])
    assert sum(w in (b"often", "often", b"again", "again") for w in learned) <= 4


@pytest.mark.parametrize("slots,most", [(1 << 19, 3 << 20), (64, 300)])
def test_coder_gives_the_tokenizers_ids(monkeypatch, slots, most):
    monkeypatch.setattr(packing.Coder, "SLOTS", slots)
    monkeypatch.setattr(packing.Coder, "MOST_IDS", most)
    coder, rng = packing.Coder(packing.tokenizer_path()), random.Random(5)
    plain = "abcde XYZ 01 .,!?\n\tàÉßÿÀþ_-"
    assert coder.by_words
    texts = ["", "don't", "DON'T 'x", "<|endoftext|>", "<", "'", "a" * 3000] + [chr(c) + "x " + chr(c) for c in range(1, 0x250)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for letters in (plain, plain + "'<|×÷—漢e\u0301\x00\x7f\x85\xa0") for _ in range(1500)]
    for k in range(0, len(texts), 100):
        for got, want in zip(coder.code(texts[k : k + 100]), coder.whole(texts[k : k + 100]), strict=True):
            assert got.tolist() == want.tolist()


def test_cut_is_exact():
    for n in range(1, 10_000):
        pieces = packing.cut(n)
        assert sum(p for p, _ in pieces) == n and all(p * k <= packing.CAPACITY for p, k in pieces)


def test_sharding(spark, docs):
    out = sharding.shard_rows(docs, 5, block=2).collect()
    assert len(out) == docs.count()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert not slots or max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_of_the_table(spark):
    """Size, checksum and law of every row, shard sizes one apart, gapless slots, and an order that owes nothing to the ids."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = sharding.query(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None) for r in out)
    slots = {k: sorted((r.slot, r.doc_id) for r in out if r.shard == k) for k in range(sharding.SHARDS)}
    assert all([s for s, _ in v] == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    rising = [a < b for v in slots.values() for (_, a), (_, b) in zip(v, v[1:], strict=False)]
    assert 0.35 < np.mean(rising) < 0.65


def test_shards_are_uniform(spark):
    """Over many seeds each row goes to every shard and every slot equally often."""
    df = spark.range(0, 12, 1, 3)
    seen = np.zeros((12, 12))
    for seed in range(40):
        for r in sharding.shard_rows(df, 3, block=2, seed=seed).collect():
            seen[r.id, r.shard * 4 + r.slot] += 1
    assert (seen.sum(0) == 40).all() and seen.max() <= 14 and abs(seen[:, :4].sum(1) - 40 / 3).max() <= 12


def test_matrix_rows_add_up_and_are_uniform():
    counts, cells = np.array([7, 0, 12, 5, 9]), sharding.shard_sizes(33, 8)
    m = np.array([sharding.matrix_row(i, counts, cells, 3) for i in range(5)])
    assert (m.sum(1) == counts).all() and (m.sum(0) == cells).all()
    mean = np.mean([sharding.matrix_row(2, counts, cells, s) for s in range(3000)], 0)
    assert np.allclose(mean, 12 * cells / 33, atol=0.1)


def test_large_hypergeometric():
    rng = np.random.Generator(np.random.PCG64(5))
    got = [sharding._hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(400)]
    assert abs(np.mean(got) - 750) < 3 and abs(np.var(got) - 187.5) < 60


def test_mixing_meets_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").drop("n_chars")
    out = mixing.mix_documents(docs).withColumn("n", F.regexp_count("text", F.lit(mixing._WORD)))
    total = out.agg(F.sum("n"), F.sum(F.col("n") * F.col("probability"))).first()
    for c in ("source", "lang", "topic"):
        rows = out.groupBy(c).agg(F.sum("n").alias("a"), F.sum(F.col("n") * F.col("probability")).alias("w")).collect()
        want = {r[c]: (r.a / total[0]) ** mixing.ALPHA for r in rows}
        for r in rows:
            assert r.w / total[1] == pytest.approx(want[r[c]] / sum(want.values()), abs=2e-3)
    assert out.where("probability > 1 OR probability < 0").count() == 0


def test_mixing_of_many_cells_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = sorted(map(tuple, mixing.rates(docs).collect()))
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 3)
    many = sorted(map(tuple, mixing.rates(docs, sweeps=10).collect()))
    assert [r[:3] for r in few] == [r[:3] for r in many] and [r[3] for r in few] == pytest.approx([r[3] for r in many], abs=2e-9)


def test_mixing_awkward(spark, docs):
    out = mixing.mix_documents(docs)
    assert out.count() == docs.count() and out.where("sampled IS NULL").count() == 0


def test_mixing_given_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("a"))
    wanted = spark.createDataFrame([("source", "a", 1.0), ("lang", "en", 0.5), ("lang", "fr", 0.5)] + [("topic", x, 0.2) for x in ("prose", "figures", "licence", "table", "contact")], "dimension string, category string, weight double")
    out = mixing.mix_documents(docs, targets=wanted)
    assert {r.lang for r in out.where("probability > 0").collect()} == {"en", "fr"}


def test_mixing_folds_no_small_source(spark):
    rows = [(i, f"w{i} " * (1 + i % 300 // 100), "en" if i % 2 else "fr", f"site{i % 300}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix_documents(docs).withColumn("n", F.regexp_count("text", F.lit(mixing._WORD)))
    got = {r.source: (r.a, r.w) for r in out.groupBy("source").agg(F.sum("n").alias("a"), F.sum(F.col("n") * F.col("probability")).alias("w")).collect()}
    total, want = sum(w for _, w in got.values()), {s: a**mixing.ALPHA for s, (a, _) in got.items()}
    for s, (_, w) in got.items():
        assert w / total == pytest.approx(want[s] / sum(want.values()), rel=0.01)
    named = [("source", "site1", 0.5), ("source", "site2", 0.5), ("lang", "en", 0.5), ("lang", "fr", 0.5), ("topic", "figures", 1.0)]
    out = mixing.mix_documents(docs, targets=spark.createDataFrame(named, "dimension string, category string, weight double"))
    assert {r.source for r in out.where("probability > 0").collect()} == {"site1", "site2"}


def test_mixing_tells_targets_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "en" if i % 2 else "fr", "a" if i % 2 else "b") for i in range(40)], "doc_id long, text string, lang string, source string")
    wanted = [("source", "a", 0.9), ("source", "b", 0.1), ("lang", "en", 0.1), ("lang", "fr", 0.9), ("topic", "prose", 1.0)]
    with pytest.warns(UserWarning, match="met together"):
        mixing.mix_documents(docs, targets=spark.createDataFrame(wanted, "dimension string, category string, weight double"))


def base_truth(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark):
    rng = random.Random(6)
    words = [*license_scan.VOCABULARY, "x", "É"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 50, 400])))) for i in range(30)]
    rows += [(100, "Released under the MIT License. MIT-license; CC BY"), (101, "This work is licensed under the GNU General Public License, version 3."), (102, "GNU Lesser General Public License, licensed under the"), *AWKWARD]
    rows += [(200 + k, f"// Copyright 2020 Somebody\n{text.upper() if k % 2 else text}\nand so on") for k, (_, text, _) in enumerate(license_scan.TEMPLATES)]
    rows += [(300, "Permission is hereby granted, free of charge, to nobody at all"), (301, "GNU General Public License version \u212a 3")]
    docs = docs_of(spark, rows)
    out = license_scan.scan_licenses(docs).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got[r.text] = r
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_truth(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    for (label, text, _), (_, whole) in zip(license_scan.TEMPLATES, rows[-2 - len(license_scan.TEMPLATES) : -2], strict=True):
        assert label in got[whole].labels.split(",") and got[whole].score >= license_scan.LEAST_SHARE, (label, text)
    assert got[rows[-2][1]].labels == "" and "gpl-3.0" not in got[rows[-1][1]].labels
    assert "gpl-3.0" in got[rows[31][1]].labels and license_scan.scan_licenses(docs_of(spark, [])).count() == 0
    assert [c for c in license_scan.scan_licenses(docs).columns if c == "score"] == ["score"]


@pytest.mark.parametrize("query,label,fold,folds,least", [(quality.query, "quality", 0, 5, 0.93), (toxicity.query, "toxic", 1, 3, 0.88)])
def test_held_out_accuracy(spark, query, label, fold, folds, least):
    sf = "/root/testdata/sf0.01"
    out = query(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert out.count() == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in held) / len(held) >= least


@pytest.mark.parametrize("fit,score", [(quality.fit, quality.score_quality), (toxicity.fit, toxicity.score_toxicity)])
def test_classifiers_awkward(spark, docs, fit, score):
    sf = "/root/testdata/sf0.01"
    given, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for some in (labels.limit(0), labels):
        name = "quality" if fit is quality.fit else "toxic"
        out = score(docs, fit(given, some, name)).collect()
        assert len(out) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 and not math.isnan(r.score) for r in out)
        assert not some.count() or len({r.score for r in out if not r.text}) <= 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_pieces(spark, rows, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())


def test_pipeline_run_awkward(spark, docs, tmp_path):
    """Null, empty, repeated and very long texts from the tables to pieces: of copies only the first id is left, and every
    document that is left is whole."""
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, 4, 6, 8, 9} and bool(out) == bool(docs.count())
    for i in {r.doc_id for r in out} - {4}:
        assert sum(r.length for r in out if r.doc_id == i) == next(r.doc_tokens for r in out if r.doc_id == i)


def test_pipeline_stages_awkward(spark, docs):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()


def test_licence_scan_of_a_text_full_of_licences(spark):
    text = "licensed under the apache license version 2 0 " * 20_000
    row = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep_text=False).first()
    assert (row.n_base, row.first_word, row.last_word, row.labels, row.score) == (20_000, 3, 8 * 19_999 + 3, "apache,apache-2.0", 1.0)
