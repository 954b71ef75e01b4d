"""Neighbours against brute force: the graph alone, many shards, copies, ties and unusable rows."""

from __future__ import annotations

import numpy as np
import pytest

from scriptorium.llm.hnsw import FlatHNSW, nearest_inside
from scriptorium.llm.neighbours import fit_centroids, near_cells, nearest


def unit(x):
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64)) * 0.9
    return unit(centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 64)))


def test_graph_recall(cloud):
    graph = FlatHNSW(cloud[:2500])
    ids, sims = graph.search(cloud[2500:], 5, 64)
    exact = cloud[2500:] @ cloud[:2500].T
    want = np.argsort(-exact, axis=1)[:, :5]
    recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, want)])
    assert recall >= 0.95
    assert np.allclose(sims, np.take_along_axis(exact, ids, 1), atol=1e-5)
    assert len(graph.members) > 1 and all(link.dtype == np.int64 for link in graph.links)


def test_small_graphs():
    for n in (1, 2, 3, 30):
        graph = FlatHNSW(unit(np.random.default_rng(n).normal(size=(n, 64))))
        ids, _ = graph.search(graph.vectors, 3, 8)
        assert (ids[:, 0] == np.arange(n)).all()
        assert ids.shape == (n, 3) and (ids[:, n:] == -1).all()


def test_nearest_inside_breaks_ties_by_id():
    same = np.repeat(unit(np.ones((1, 64))), 5, 0)
    ids, _ = nearest_inside(same, 3)
    assert set(ids[4]) <= {0, 1, 2, 3}


def frame(spark, vectors, extra=()):
    rows = [(f"k{i:05}", [float(x) for x in v], 1) for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, "id string, embedding array<float>, shard int")


def test_many_shards_recall(spark, cloud):
    got = nearest(frame(spark, cloud), shard_rows=300, sample_rows=1500, margin=0.3, ef=48).collect()
    exact = cloud.astype(float) @ cloud.astype(float).T
    np.fill_diagonal(exact, -2)
    want = np.argsort(-exact, axis=1, kind="stable")[:, :5]
    found = {}
    for r in got:
        found.setdefault(int(r["id"][1:]), set()).add(int(r["neighbour"][1:]))
        assert r["cosine"] == pytest.approx(exact[int(r["id"][1:]), int(r["neighbour"][1:])], abs=1e-5)
    assert len(got) == 5 * len(cloud)
    assert np.mean([len(found[i] & set(want[i])) / 5 for i in range(len(cloud))]) >= 0.9


def test_hot_cell_is_cut_into_shards(spark):
    rng = np.random.default_rng(8)
    crowd = unit(np.ones((1, 64)) + 0.05 * rng.normal(size=(700, 64)))
    rest = unit(rng.normal(size=(300, 64)))
    vectors = np.vstack([crowd, rest])
    got = nearest(frame(spark, vectors), shard_rows=100, sample_rows=200, margin=0.3).collect()
    exact = vectors.astype(float) @ vectors.astype(float).T
    np.fill_diagonal(exact, -2)
    want = np.argsort(-exact, axis=1)[:, :5]
    hit = sum(int(r["neighbour"][1:]) in want[int(r["id"][1:])] for r in got)
    assert hit / (5 * len(vectors)) >= 0.9


def test_copies_ties_and_unusable_rows(spark):
    a, b = [1.0] + [0.0] * 63, [0.96, 0.28] + [0.0] * 62
    extra = [(f"copy{i}", [2.0 * x for x in a], 1) for i in range(8)] + [("near", b, 1)]
    extra += [("null", None, 1), ("empty", [], 1), ("short", [1.0], 1), ("zero", [0.0] * 64, 1), ("nan", [float("nan")] + a[1:], 1), ("hole", [None] + a[1:], 1), ("inf", [float("inf")] + a[1:], 1), (None, a, 1), ("copy0", [2.0 * x for x in a], 1)]
    got = nearest(frame(spark, [], extra), min_cosine=0.9).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["id"], []).append(r["neighbour"])
    assert set(found) == {f"copy{i}" for i in range(8)} | {"near"}
    assert found["copy7"] == [f"copy{i}" for i in range(5)]
    assert found["copy0"] == [f"copy{i}" for i in range(1, 6)]
    assert found["near"] == [f"copy{i}" for i in range(5)]


def test_empty_and_single(spark):
    assert nearest(spark.createDataFrame([], "id string, embedding array<float>")).count() == 0
    assert nearest(frame(spark, unit(np.ones((1, 64))))).count() == 0


def test_centroids_of_few_rows():
    assert fit_centroids(unit(np.eye(3, 64) + 0.01), 10).shape == (3, 64)


def test_band_keeps_to_cells_whose_border_is_near():
    """Cells that lie close to one another have close scores everywhere; a row is sent to those whose border it is near."""
    rng = np.random.default_rng(3)
    centroids = unit(np.eye(1, 64) + 0.03 * rng.normal(size=(200, 64)))
    rows = unit(centroids[rng.integers(0, 200, 2000)] + 0.005 * rng.normal(size=(2000, 64)))
    visited = lambda **how: sum(len(cell) for *_, cell in near_cells(rows, centroids, 0.12, **how))
    assert visited() == 200 * 2000
    assert 2000 <= visited(band=0.08) < 2 * 2000
    score = rows @ centroids.T
    best = score.argmax(1)
    far = (score[np.arange(2000), best][:, None] - score) / np.maximum(np.linalg.norm(centroids[best][:, None] - centroids[None], axis=2), 1e-9)
    assert visited(band=0.08) == (far <= 0.08).sum()


def test_band_finds_the_pairs(spark, cloud):
    rng = np.random.default_rng(9)
    near = unit(cloud[:400] + 0.03 * rng.normal(size=(400, 64)))
    got = nearest(frame(spark, np.vstack([cloud, near])), min_cosine=0.9, shard_rows=100, sample_rows=1500, band=0.08).collect()
    found = {(r["id"], r["neighbour"]) for r in got}
    pairs = [(i, len(cloud) + i) for i in range(400) if cloud[i] @ near[i] >= 0.9]
    assert len(pairs) > 350 and np.mean([(f"k{a:05}", f"k{b:05}") in found and (f"k{b:05}", f"k{a:05}") in found for a, b in pairs]) >= 0.99


def test_copies_of_copies(spark):
    """Thirty copies of each of ten near vectors: ties by key, through several groups."""
    rng = np.random.default_rng(6)
    base = unit(np.ones((1, 64)) + 0.1 * rng.normal(size=(10, 64)))
    vectors = np.vstack([base[:4]] + [np.repeat(base[4:], 3, 0)] + [np.repeat(base[9:], 30, 0)])
    got = nearest(frame(spark, vectors)).collect()
    exact = np.round(vectors.astype(float) @ vectors.astype(float).T, 6)
    np.fill_diagonal(exact, -2)
    want = {(f"k{i:05}", f"k{j:05}", at + 1) for i in range(len(vectors)) for at, j in enumerate(np.argsort(-exact[i], kind="stable")[:5])}
    assert {(r["id"], r["neighbour"], r["rank"]) for r in got} == want
