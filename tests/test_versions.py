"""Versions compared by trees of fingerprints, and approximate vector search."""

import shutil

import numpy as np
import pytest

from corpusmill.operators import ann, retrieval, versions


def store(spark, path, rows):
    versions.write_version(spark.createDataFrame(rows, "doc_id long, text string"), path, 3, 1)
    return path


def test_versions(spark, tmp_path):
    base = [(i, f"text {i}") for i in range(300)] + [(500, "a"), (500, "b"), (None, "x"), (600, None)]
    old = store(spark, f"{tmp_path}/old", base)
    assert versions.changes(spark, old, store(spark, f"{tmp_path}/same", [*reversed(base[:-1]), (600, "")]), 3, 1).count() == 0
    new = [(i, f"text {i}" + ("!" if i == 7 else "")) for i in range(299)] + [(500, "a"), (500, "c"), (None, "y"), (600, ""), (1 << 40, "")]
    got = {(r.id, r.change) for r in versions.changes(spark, old, store(spark, f"{tmp_path}/new", new), 3, 1).collect()}
    assert got == {("7", "changed"), ("299", "removed"), ("500", "changed"), ("null", "changed"), (str(1 << 40), "added")}
    empty = store(spark, f"{tmp_path}/none", [])
    assert versions.changes(spark, empty, empty, 3, 1).count() == 0 and versions.changes(spark, empty, old, 3, 1).count() == 303
    with pytest.raises(ValueError):
        versions.changes(spark, old, old, 2, 1)


def test_only_folders_with_a_difference_are_read(spark, tmp_path):
    base = [(i, "t") for i in range(200)]
    old, new = store(spark, f"{tmp_path}/a", base), store(spark, f"{tmp_path}/b", [(i, "u" if i == 5 else "t") for i in range(200)])
    top = versions.digests(spark.createDataFrame([(5, "")], "doc_id long, text string"), top=1).first().top
    for folder in (*tmp_path.glob("*/digests/top=*"),):
        if folder.name != f"top={top}":
            shutil.rmtree(folder)  # nothing else is needed
    assert [(r.id, r.change) for r in versions.changes(spark, old, new, 3, 1).collect()] == [("5", "changed")]


def vectors(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    x = centres[np.arange(n) % 12] + 0.4 * rng.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def test_lists_reach_the_recall(spark):
    v = vectors(spark, 900)
    asked, centres = v.where("vec_id % 20 = 0"), ann.fit_centroids(v)
    probes, measured = ann.lists_needed(v, asked, centres, 10, 0.95)
    assert measured >= 0.95 and probes < len(centres)
    exact = retrieval.dense(v, asked, 10)
    row = ann.recall(ann.search(v, asked, centres, 10, probes), exact).first()
    assert row.wanted == 450 and row.recall >= 0.9
    every = ann.search(v, asked, centres, 10, len(centres))
    assert sorted(map(tuple, every.select("q_id", "vec_id", "score", "rank").collect())) == sorted(map(tuple, exact.select("q_id", "vec_id", "score", "rank").collect()))


def test_search_awkward(spark):
    v = vectors(spark, 30).union(spark.createDataFrame([(None, [1.0] * 16), (99, None), (100, [3.0] * 16)], "vec_id long, embedding array<double>"))
    centres = ann.fit_centroids(v, lists=4)
    got = ann.search(v, v.where("vec_id = 100"), centres, 40, 4).collect()
    assert {r.vec_id for r in got} == set(range(30)) | {100} and max(r.score for r in got) == 1.0
    none = v.limit(0)
    assert ann.search(none, none, ann.fit_centroids(none), 5, 1).count() == 0 and ann.lists_needed(none, none, ann.fit_centroids(none), 5, 0.9)[1] == 1.0
