"""Similarity join against all pairs, with copies, crowded pigeonholes and dirty rows."""

from __future__ import annotations

import random
import re

import pytest

from scriptorium.llm import near_duplicates as D


def shingles(text, words):
    got = re.findall("[a-z0-9]+", (text or "").lower())
    return frozenset(tuple(got[i : i + words]) for i in range(len(got) - words + 1))


def brute(rows, words, threshold):
    sets = [(k, shingles(t, words)) for k, t in rows if k is not None]
    return {(min(a, b), max(a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a != b and x and y and len(x & y) >= threshold * len(x | y)}


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 200]))]
        for v in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((f"r{f:02}{v}", " ".join(words)))
    rows += [("copy1", rows[0][1].upper()), ("copy2", rows[0][1]), ("null", None), ("empty", ""), ("two", "a b"), ("signs", "!!! ... ---"), (None, rows[0][1]), ("cyr", "Привет мир снова")]
    return rows


@pytest.mark.parametrize("words,threshold", [(3, 0.6), (5, 0.8)])
def test_pairs(spark, words, threshold):
    rows = made(4)
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "id string, text string, n int, class string").repartition(4)
    got = [tuple(r) for r in D.near_duplicate_pairs(frame, words=words, threshold=threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, words, threshold)


@pytest.mark.parametrize("hot,most_met", [(1, 512), (1, 2), (2, 3)])
def test_crowded_pigeonholes(spark, hot, most_met):
    rows = [r for r in made(6) if r[0]]
    frame = spark.createDataFrame(rows, "id string, text string")
    made_rows, heads = D.classes(frame, words=3, threshold=0.6)
    links = {(r["class_a"], r["class_b"]) for r in D.similar_classes(made_rows, heads, frame, words=3, threshold=0.6, hot=hot, most_met=most_met).collect()}
    classes = {r["class"] for r in heads.collect()}
    want = {p for p in brute(rows, 3, 0.6) if set(p) <= classes and shingles(dict(rows)[p[0]], 3) != shingles(dict(rows)[p[1]], 3)}
    assert links == want


def test_fullest_pigeonholes_are_dealt_at_once(spark, monkeypatch):
    monkeypatch.setattr(D, "fullest_holes", lambda made: D.np.sort(D.spread_holes(made, D.np.zeros(0, D.np.int64)).groupBy("hole").count().where("count > 2").toPandas()["hole"].to_numpy()))
    rows = [r for r in made(6) if r[0]]
    frame = spark.createDataFrame(rows, "id string, text string")
    assert {tuple(r) for r in D.near_duplicate_pairs(frame, words=3, threshold=0.6).collect()} == brute(rows, 3, 0.6)


def test_sampled_pigeonholes(spark):
    rows = spark.range(2000).selectExpr("id * 8 as h1", "10 as n", "array(7L, 100 + id) as cells")
    assert D.fullest_holes(rows).tolist() == [7]


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_layouts(threshold):
    for band in range(6, 16):
        cells, times = D.layout(band, threshold)
        assert times <= 5
        assert min(D.expected_matches(n, cells, threshold, band <= D.SMALL_BAND) for n in (2 ** (band - 1) + 1, 2**band)) * times >= D.EXPECTED * 0.8


@pytest.mark.parametrize("most_met", [2, 5])
def test_overfull_pigeonholes(spark, most_met):
    """Texts put together from the same two versions of 42 places fill all their pigeonholes; no pair is lost."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        versions = [rng.randrange(2) for _ in range(42)]
        rows.append((f"r{k:02}", " ".join(f"w{i}" if i % 6 else f"x{i}v{versions[i // 6]}" for i in range(252))))
    frame = spark.createDataFrame(rows, "id string, text string")
    made_rows, heads = D.classes(frame, words=3, threshold=0.6)
    links = {(r["class_a"], r["class_b"]) for r in D.similar_classes(made_rows, heads, frame, words=3, threshold=0.6, hot=1, most_met=most_met).collect()}
    assert links == brute(rows, 3, 0.6)


def test_pairs_of_few_shingles(spark):
    """Each text of few shingles beside one with words put after it or its last word changed."""
    rng = random.Random(9)
    rows, word = [], lambda: f"w{rng.randrange(10**9)}"
    for k, (size, kept, more) in enumerate(((2, 2, 1), (3, 3, 2), (4, 3, 1), (5, 4, 1), (5, 5, 3), (12, 10, 3)) * 60):
        words = [word() for _ in range(size + 2)]
        rows += [(f"a{k:03}", " ".join(words)), (f"b{k:03}", " ".join(words[: kept + 2] + [word() for _ in range(more)]))]
    frame = spark.createDataFrame(rows, "id string, text string")
    got = {tuple(r) for r in D.near_duplicate_pairs(frame, words=3, threshold=0.6).collect()}
    assert got == {(f"a{k:03}", f"b{k:03}") for k in range(360)}


def test_groups(spark):
    rows = [r for r in made(5)]
    frame = spark.createDataFrame(rows, "id string, text string")
    got = {r["id"]: r for r in D.near_duplicate_groups(frame, words=3, threshold=0.6).collect()}
    pairs = brute(rows, 3, 0.6)
    assert set(got) == {k for k, t in rows if k and shingles(t, 3)}
    assert all(got[a]["group"] == got[b]["group"] for a, b in pairs)
    assert got["copy1"]["class"] == got["copy2"]["class"]
    linked = {a for p in pairs for a in p}
    assert all(got[k]["links"] == 0 and got[k]["group"] == k for k in got if k not in linked)


def test_empty(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert D.near_duplicate_pairs(empty).count() == 0 and D.near_duplicate_groups(empty).count() == 0


def test_sketch_bound():
    rng = random.Random(2)
    import numpy as np

    for _ in range(200):
        a = {rng.getrandbits(64) for _ in range(rng.randint(1, 90))}
        b = {x for x in a if rng.random() < 0.8} | {rng.getrandbits(64) for _ in range(rng.randint(0, 60))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if len(b):
            assert D.hamming(D.bit_sketch(x, len(a)), D.bit_sketch(y, len(b))) <= len(a ^ b)
