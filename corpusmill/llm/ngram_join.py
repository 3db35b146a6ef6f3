"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard similarity of THRESHOLD or more.

Candidates come from a MinHash LSH forest. Each of TREES trees is a sorted prefix trie of DEPTH-value signatures: rows are
range-partitioned and sorted by (tree, signature) once, and neighbours are linked by how many values they share, so a
crowded trie node costs one link a row, not all pairs (the deepest spanning links of each partition are kept). Matched
prefixes are shortened adaptively: the first candidate groups come from the longest prefix with which any pair at the threshold is
found with TARGET_RECALL, whatever the table holds. All their links are verified and counted by similarity; if those counts let
LOST links or more be expected beyond the groups, the prefix is shortened until fewer are (`shortened`), and the larger groups
are verified. Nothing is sampled. A loose group over SPLIT_FROM documents is first split by an
exact index of its rarest shingles: two sets that are similar enough share one of their n - ceil(THRESHOLD n) + 1 rarest,
so documents that only share a common passage part. Each group is verified exactly on whole shingle sets, in blocks of
BLOCK documents so that a group of any size spreads over tasks. Counts and spanning links leave a task, never all pairs.

Words are runs of bytes other than ASCII white space, unchanged. A text of one to four words has one shingle of all
its words. Equal word sequences are one class, represented by its smallest id; they aren't compared with each other.

Defined results: null counts as empty; documents without words form one class without links; a null id is the
largest id; rows that share id and text are one document; an empty table gives no rows; other columns are ignored.
Shingles are told apart by 64-bit hashes. A single document's shingles must fit a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import join_small, written
from .text import blocks, mix, release, shingle_sets, span_hashes, split_words

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, LEAST_DEPTH, TARGET_RECALL = 20, 7, 2, 0.9999
BLOCK = 1024
#: The prefix is shortened until fewer links than this are expected to be missed in the whole table.
LOST = 1
#: Groups of more documents are split first, if they are loose; up to this size verifying all blocks costs less than splitting.
SPLIT_FROM = 32 * BLOCK
#: A large group whose documents are as similar as this on average is verified without splitting it first.
DENSE = 0.6
_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(0, 1 << 31, TREES * DEPTH).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)


def found_share(similarity: float, depth: int, trees: int = TREES) -> float:
    """How likely a pair of this similarity shares a node of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def recall_at(pairs: dict[int, int], depth: int, measured: int = DEPTH, threshold: float = THRESHOLD) -> float:
    """Estimated share of all similar pairs that a depth finds. pairs: how many pairs of each hundredth of similarity were
    found at depth `measured`; each stands for 1 / found_share pairs. One more pair at the threshold is assumed, so that
    few or no pairs are no reason for a long prefix."""
    weights = {s / 100: n / found_share(s / 100, measured) for s, n in pairs.items()}
    weights[threshold] = weights.get(threshold, 0) + 1
    return sum(w * found_share(s, depth) for s, w in weights.items()) / sum(weights.values())


def match_depth(pairs: dict[int, int], target: float = TARGET_RECALL, threshold: float = THRESHOLD) -> int:
    """The longest prefix with which the target recall is reached."""
    return next((d for d in range(DEPTH, LEAST_DEPTH, -1) if recall_at(pairs, d, threshold=threshold) >= target), LEAST_DEPTH)


def shortened(pairs: dict[int, int], depth: int) -> int:
    """The longest prefix of at most `depth` values with which fewer than LOST links are expected to be missed. pairs: how many
    links of each hundredth of similarity were found at `depth`, all of them; each stands for 1 / found_share links."""
    lost = lambda d: sum(n * (1 - found_share(s / 100, d)) / found_share(s / 100, depth) for s, n in pairs.items())
    return next((d for d in range(depth, LEAST_DEPTH, -1) if lost(d) < LOST), LEAST_DEPTH)


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, d1, d2, text) -> id, d1, d2, 128-bit key of the word sequence, signature (empty without words)."""
    for batch in batches:
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "d1", "d2")]
        for row, n, data, offsets in blocks(batch.column(batch.schema.get_field_index("text"))):
            starts, ends, first = split_words(data, offsets)
            words = span_hashes(data, starts, ends)
            shingles, counts = shingle_sets(words, first, WORDS)
            place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
            keys = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(mix(words + np.uint64(salt)) + place * np.uint64(salt)), dtype=np.uint64)])
                keys.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
            some = np.flatnonzero(counts)
            signature = np.zeros((len(some), TREES * DEPTH), np.uint32)
            if len(some):
                x = (shingles >> np.uint64(32)).astype(np.uint32)
                heads = (np.cumsum(counts) - counts)[some]
                for i in range(TREES * DEPTH):
                    v = x * _A[i] + _B[i]
                    v ^= v >> np.uint32(15)
                    v *= np.uint32(0x2C1B3C6D)
                    v ^= v >> np.uint32(12)
                    signature[:, i] = np.minimum.reduceat(v, heads)
            rows = np.full(n, None, object)
            for i, r in enumerate(some):
                rows[r] = signature[i].astype(">u4").tobytes()
            yield pa.RecordBatch.from_arrays([*(c.slice(row, n) for c in kept), pa.array(keys[0]), pa.array(keys[1]), pa.array(rows, pa.binary())], names=["id", "d1", "d2", "k1", "k2", "signature"])
    release()


def _spanning(u: np.ndarray, v: np.ndarray, depth: np.ndarray) -> list[tuple[int, int, int]]:
    """Links that connect the same nodes at every depth, the deepest first: a maximum spanning forest."""
    order = np.lexsort((v, u, -depth))
    u, v, depth = u[order], v[order], depth[order]
    _, first = np.unique(np.stack([u, v], 1), axis=0, return_index=True)
    top: dict[int, int] = {}
    out = []
    for i in np.sort(first).tolist():
        a, b = int(u[i]), int(v[i])
        x, y = a, b
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        while (up := top.setdefault(y, y)) != y:
            top[y] = y = top[up]
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((a, b, int(depth[i])))
    return out


def _forest_batches(width: int, least: int, most: int = 1 << 20):
    """Sorted (tree, path, id) of one partition -> links (u, v, depth) of neighbours that share `least` of the path's
    `width` values or more, and the partition's two end rows (tree, head, u)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[tuple] = []
        links: list[np.ndarray] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            tree, ids = col("tree").to_numpy(), col("id").to_numpy()
            path = np.frombuffer(b"".join(col("path").to_pylist()), ">u4").reshape(-1, width)
            if last is None:
                ends.append((int(tree[0]), path[0].tobytes(), int(ids[0])))
            else:
                tree, ids, path = np.append(last[0], tree), np.append(last[1], ids), np.vstack([last[2], path])
            last = tree[-1:], ids[-1:], path[-1:].copy()
            shared = np.cumprod(path[1:] == path[:-1], axis=1).sum(1)
            keep = (shared >= least) & (tree[1:] == tree[:-1]) & (ids[1:] != ids[:-1])
            links.append(np.stack([np.minimum(ids[1:], ids[:-1]), np.maximum(ids[1:], ids[:-1]), shared])[:, keep])
            if sum(x.shape[1] for x in links) > most:
                links = [np.array(_spanning(*np.concatenate(links, 1)), np.int64).reshape(-1, 3).T]
        if last is not None:
            ends.append((int(last[0][0]), last[2][0].tobytes(), int(last[1][0])))
        spanning = _spanning(*np.concatenate(links, 1)) if links else []
        rows = [(None, None, u, v, d) for u, v, d in spanning] + [(t, p, u, None, None) for t, p, u in ends]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["tree", "head", "u", "v", "depth"])

    return run


_LINKS = "tree int, head binary, u long, v long, depth int"


def forest(signatures: DataFrame) -> DataFrame:
    """signatures(id, signature) -> the trees' links and partition ends, for `links_at`."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    paths = signatures.select("id", tree, "signature").select("tree", F.expr(f"substring(signature, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("path"), "id")
    return written(paths.repartitionByRange("tree", "path", "id").sortWithinPartitions("tree", "path", "id").mapInArrow(_forest_batches(DEPTH, LEAST_DEPTH), _LINKS), "forest")


def links_at(trees: DataFrame, depth: int) -> DataFrame:
    """links(u, v) whose components hold every pair that shares a node of this depth."""
    # a run cut by partition borders: its ends meet by their prefix
    ends = trees.where("v IS NULL").select(F.col("tree"), F.substring("head", 1, 4 * depth).alias("head"), "u")
    across = ends.join(ends.groupBy("tree", "head").agg(F.min("u").alias("v")), ["tree", "head"]).select("u", "v")
    return trees.where(F.col("depth") >= depth).select("u", "v").union(across)


def _rare_batches(threshold: float):
    """(component, id, shared: structs of a shingle's count and hash) -> the rarest that two similar sets must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_pylist()
            for component, node, size, shared in zip(col("component"), col("id"), col("size"), col("shared"), strict=True):
                # shingles that no other set has come first of all: they fill places but need no link
                places = size - int(np.ceil(threshold * size - 1e-9)) + 1 - (size - len(shared))
                for x in sorted((s["n"], s["s"]) for s in shared)[: max(0, places)]:
                    out[0].append(component)
                    out[1].append(x[1])
                    out[2].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["component", "shingle", "id"])

    return run


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, id, shingles) -> a row a shingle, a few documents at a time."""
    for big in batches:
        for k in range(0, big.num_rows, 256):
            batch = big.slice(k, 256)
            sets = [np.frombuffer(x, np.int64) for x in batch.column(batch.schema.get_field_index("shingles")).to_pylist()]
            n = np.array([len(x) for x in sets])
            repeat = lambda c, b=batch, n=n: np.repeat(b.column(b.schema.get_field_index(c)).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(repeat("component")), pa.array(repeat("id")), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))], names=["component", "id", "size", "s"])


def split_large(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sets(id, component, shingles) of large groups -> (id, component) of finer groups that part no similar pair.

    A shingle's number of sets is counted in its group, before the shuffle as far as possible; only shingles of two sets or
    more, and of those the rarest of each set, are linked, each to its least set.
    """
    rows = written(sets.mapInArrow(_shingle_batches, "component long, id long, size long, s long"), "shingles")
    counts = rows.groupBy("component", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = rows.join(counts, ["component", "s"]).groupBy("component", "id", "size").agg(F.collect_list(F.struct("n", "s")).alias("shared"))
    rare = written(kept.mapInArrow(_rare_batches(threshold), "component long, shingle long, id long"), "rare")
    least = rare.groupBy("component", "shingle").agg(F.min("id").alias("v"))
    return components(rare.join(least, ["component", "shingle"]).select(F.col("id").alias("u"), "v")).select(F.col("node").alias("id"), "component")


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component, text) -> sorted distinct shingles as packed bytes."""
    for batch in batches:
        for row, n, data, offsets in blocks(batch.column(batch.schema.get_field_index("text"))):
            starts, ends, first = split_words(data, offsets)
            shingles, counts = shingle_sets(span_hashes(data, starts, ends), first, WORDS)
            at = np.cumsum(counts) - counts
            packed = [np.unique(shingles[a : a + c]).tobytes() for a, c in zip(at, counts, strict=True)]
            keep = [batch.column(batch.schema.get_field_index(c)).slice(row, n) for c in ("id", "component")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(packed, pa.binary())], names=["id", "component", "shingles"])


def _similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which of left x right are similar enough, and the number of these links by hundredths of similarity (0 to 100); exact
    counts by a product of incidence matrices over shared shingles. same: both sides are the same rows, none is linked to itself."""
    a, b = np.concatenate(left), np.concatenate(right)
    na, nb = (np.array([len(x) for x in s]) for s in (left, right))
    ra, rb = np.repeat(np.arange(len(left)), na), np.repeat(np.arange(len(right)), nb)
    shared = np.intersect1d(a, b)
    ca, cb = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ina = (ca < len(shared)) & (shared[np.minimum(ca, max(0, len(shared) - 1))] == a) if len(shared) else np.zeros(len(a), bool)
    inb = (cb < len(shared)) & (shared[np.minimum(cb, max(0, len(shared) - 1))] == b) if len(shared) else np.zeros(len(b), bool)
    ra, ca, rb, cb = ra[ina], ca[ina], rb[inb], cb[inb]
    both = np.zeros((len(left), len(right)), np.float32 if max(na.max(), nb.max()) < 1 << 24 else np.float64)
    step = max(256, (2 << 20) // max(len(left), len(right)))
    for lo in range(0, len(shared), step):
        x, y = (np.zeros((n, min(step, len(shared) - lo)), np.float32) for n in (len(left), len(right)))
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            here = (c >= lo) & (c < lo + step)
            m[r[here], c[here] - lo] = 1
        both += x @ y.T
    total = na[:, None] + nb[None, :]
    hit = (1 + threshold) * both.astype(np.float64) >= threshold * total - 1e-9
    if same:
        np.fill_diagonal(hit, False)
    counts = np.zeros(101, np.int64)
    for lo in range(0, len(left), 128):  # a few rows at a time: in a dense group nearly all pairs are links
        here = hit[lo : lo + 128]
        m = both[lo : lo + 128][here].astype(np.float64)
        counts += np.bincount(np.floor(100 * m / np.maximum(total[lo : lo + 128][here] - m, 1) + 1e-4).astype(np.int64), minlength=101)
    return hit, counts // 2 if same else counts


def connected(hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each connected part of a matrix of links between rows and columns; a row or column is looked at once."""
    back = np.ascontiguousarray(hit.T)
    rows_left, columns_left = hit.any(1), hit.any(0)
    while rows_left.any():
        edge = np.array([rows_left.argmax()])
        rows_left[edge] = False
        rows, columns = [edge], []
        while len(edge):
            met = np.flatnonzero(hit[edge].any(0) & columns_left)
            columns_left[met] = False
            edge = np.flatnonzero(back[met].any(0) & rows_left) if len(met) else met
            rows_left[edge] = False
            columns.append(met)
            rows.append(edge)
        yield np.concatenate(rows), np.concatenate(columns)


def _verify_batches(threshold: float):
    """Rows (task, side_a, side_b, id, shingles) sorted by task -> (id, links, near): verified links of each document in
    that task, and the least document it is connected to there. Rows without an id count, for each hundredth of
    similarity (near), all links verified."""

    measured = np.zeros(101, np.int64)

    def flush(rows: list[tuple]) -> list[tuple]:
        rows = [r for k, r in enumerate(rows) if not k or r[2] != rows[k - 1][2]]  # rows that share id and text
        ids = [r[2] for r in rows]
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        a, b = [i for i, r in enumerate(rows) if r[0]], [i for i, r in enumerate(rows) if r[1]]
        if not a or not b:
            return []
        hit, counts = _similar([sets[i] for i in a], [sets[i] for i in b], threshold, a == b)
        links = np.zeros(len(rows), np.int64)
        if a == b:
            links[a] = hit.sum(1)
        else:
            links[a] += hit.sum(1)
            links[b] += hit.sum(0)
        measured[:] += counts
        least = np.array(ids, np.int64)
        for rows_of, columns_of in connected(hit):
            members = np.concatenate([np.array(a)[rows_of], np.array(b)[columns_of]])
            least[members] = least[members].min()
        return [(ids[i], int(links[i]), int(least[i])) for i in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, out = None, [], []
        measured[:] = 0

        def packed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "links", "near"])

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("component", "i", "j", "side_a", "side_b", "id", "shingles")]
            for c, i, j, *row in zip(*cols, strict=True):
                if (c, i, j) != task:
                    out += flush(rows)
                    task, rows = (c, i, j), []
                rows.append(tuple(row))
            yield packed()
            out = []
        out += flush(rows)
        out += [(None, int(measured[s]), s) for s in np.flatnonzero(measured).tolist()]
        yield packed()
        rows = out = []
        release()

    return run


def verified_links(sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """sets(id, component, shingles) -> (id, links, near) of each verification task a document has links in, and rows
    without an id: the number of links of each hundredth of similarity (near)."""
    sizes = sets.groupBy("component").count().where("count > 1").withColumn("n", F.ceil(F.col("count") / block).cast("int"))
    placed = sets.join(sizes.select("component", "n"), "component").withColumn("mine", F.expr("cast(pmod(xxhash64(id), n) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    tasks = placed.select("component", "mine", "id", "shingles", other).select(
        "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.expr("mine <= other").alias("side_a"), F.expr("mine >= other").alias("side_b"), "id", "shingles"
    )
    return tasks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id").mapInArrow(_verify_batches(threshold), "id long, links long, near long")


def _digests(text) -> list:
    """128 bits of a text in two columns."""
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("d2"), text).alias("d2")]


def loose(groups: DataFrame, signatures: DataFrame, values: int = 8) -> DataFrame:
    """Of groups(node, component) those (component) whose documents are less similar to each other than DENSE on average: the
    share of pairs with equal signature values, by counts of the values."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(values - 1)), lambda i: F.struct(i.alias("i"), F.substring("signature", 1 + 4 * i, F.lit(4)).alias("v")))).alias("x")
    counts = groups.join(signatures.select(F.col("id").alias("node"), "signature"), "node").select("component", each).groupBy("component", "x").agg(F.count(F.lit(1)).cast("double").alias("n"))
    alike = counts.groupBy("component").agg((F.sum(F.col("n") * F.col("n")) * values / (F.sum("n") * F.sum("n"))).alias("alike"))
    return alike.where(F.col("alike") < DENSE).select("component")


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float, block: int = BLOCK, split_from: int = SPLIT_FROM, sample: int | None = None) -> DataFrame:
    """(id, d1, d2, copy_of, class_id, n_links, stays) for every row of docs; d1 and d2 tell its text, stays whether it
    represents its group: it has the smallest id, and the words of the first class with that id. No sample is taken; the
    argument is accepted for older callers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *_digests(text)).select("id", "d1", "d2", "text")
    signed = written(rows.mapInArrow(_signature_batches, "id long, d1 long, d2 long, k1 long, k2 long, signature binary"), "signatures")
    first = F.min_by(F.struct("d1", "d2", "signature"), F.struct(F.col("id").isNull(), F.col("id"))).alias("first")
    classes = signed.groupBy("k1", "k2").agg(F.min("id").alias("copy_of"), first).select("k1", "k2", "copy_of", "first.*")
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    lone = classes.where("signature IS NOT NULL").select(F.col("node").alias("id"), "signature")
    trees = forest(lone)

    def sets_of(groups: DataFrame, size: int) -> DataFrame:
        """(id, component, shingles) of the documents of some groups."""
        same = F.col("id").eqNullSafe(F.col("copy_of")) & (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2"))
        named = groups.join(classes.select("node", "copy_of", F.col("d1").alias("g1"), F.col("d2").alias("g2")), "node")
        texts = join_small(rows, named, same, "inner", size).select(F.col("node").alias("id"), "component", "text")
        return written(texts.mapInArrow(_set_batches, "id long, component long, shingles binary"), "sets")

    def verified(depth: int) -> tuple[DataFrame, dict[int, int]]:
        """(id, links, near) of all links in the groups of this depth, and their number by hundredths of similarity."""
        groups = written(components(links_at(trees, depth)), "candidates")
        sets, large = sets_of(groups, groups.count()), written(groups.groupBy("component").count().where(F.col("count") > split_from).select("component"), "crowds")
        if large.count():
            large = written(loose(join_small(groups, large, "component", "left_semi"), lone), "large")
        if large.count():
            crowded, rest = (join_small(sets, large, "component", how) for how in ("left_semi", "left_anti"))
            finer = written(split_large(crowded, threshold), "finer")
            sets = written(rest.unionByName(join_small(crowded.drop("component"), finer, "id", "inner").select("id", "component", "shingles")), "sets")
        found = written(verified_links(sets, threshold, block), "verified")
        counts = found.where("id IS NULL").groupBy("near").agg(F.sum("links").alias("n")).collect()  # at most 101 rows
        return found.where("id IS NOT NULL"), {r.near: r.n for r in counts}

    depth = match_depth({}, threshold=threshold)  # holds for any pair, whatever the table holds
    found, pairs = verified(depth)
    if (shorter := shortened(pairs, depth)) < depth:
        found, _ = verified(shorter)
    links = found.groupBy("id").agg(F.sum("links").alias("n_links")).withColumnRenamed("id", "node")
    near = components(found.select(F.col("id").alias("u"), F.col("near").alias("v")))
    linked = written(links.join(near, "node").join(classes.select("node", "k1", "k2", "copy_of"), "node"), "linked")
    order = F.struct(F.col("copy_of").isNull(), "copy_of", "k1", "k2")
    best = written(linked.groupBy("component").agg(F.min("copy_of").alias("class_id"), F.min(order).alias("head")), "groups")
    head = (F.col("k1") == F.col("head.k1")) & (F.col("k2") == F.col("head.k2"))
    linked = join_small(linked, best, "component", "inner").select("node", "class_id", "n_links", head.alias("head"))
    info = classes.select("k1", "k2", "node", "copy_of").join(linked, "node", "left")
    class_id = F.when(F.col("head").isNull(), F.col("copy_of")).otherwise(F.col("class_id")).alias("class_id")
    out = signed.select("id", "d1", "d2", "k1", "k2").join(info.select("k1", "k2", "copy_of", class_id, "n_links", "head"), ["k1", "k2"])
    stays = F.col("id").eqNullSafe(F.col("class_id")) & F.coalesce("head", F.lit(True))
    return out.select("id", "d1", "d2", "copy_of", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), stays.alias("stays"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """(id, copy_of, class_id, n_links) for every row of docs; settings: the block size and the size from which groups are split, if others.

    copy_of: smallest id with the same words; class_id: smallest id connected by similarity; n_links: how many other
    word sequences are similar to this one.
    """
    return _classed(docs, id_col, text_col, threshold, **settings).select(F.col("id").alias(id_col), "copy_of", "class_id", "n_links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, the smallest id, of each group of similar ones. A row goes by its id and its text."""
    gone = _classed(docs, id_col, text_col, THRESHOLD).where("NOT stays").select(F.col("id").alias("__id"), F.col("d1").alias("__g1"), F.col("d2").alias("__g2"))
    gone = written(gone.distinct(), "near")
    d1, d2 = _digests(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__d1") == F.col("__g1")) & (F.col("__d2") == F.col("__g2"))
    return join_small(docs.select("*", d1.alias("__d1"), d2.alias("__d2")), gone, same, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, min(doc_id) OVER (PARTITION BY ws) AS copy_of FROM w),
s AS (SELECT DISTINCT doc_id AS d, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i+4], ' '))) WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE [] END) AS g FROM c WHERE doc_id = copy_of),
n AS (SELECT d, count(*) AS n FROM s GROUP BY d),
p AS (SELECT a.d AS x, b.d AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.d <> b.d GROUP BY a.d, b.d),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.d JOIN n ny ON y = ny.d WHERE m >= 0.8 * (nx.n + ny.n - m) - 1e-9),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x, least(x, min(y)) AS class_id FROM r GROUP BY x),
l AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT c.doc_id, c.copy_of, coalesce(k.class_id, c.copy_of) AS class_id, coalesce(l.n_links, 0) AS n_links
FROM c LEFT JOIN k ON k.x = c.copy_of LEFT JOIN l ON l.x = c.copy_of
"""


def query(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
