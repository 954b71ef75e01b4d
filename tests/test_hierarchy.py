"""Contraction against breadth-first search on random graphs, with loops, hubs, long chains and dirty lists."""

from __future__ import annotations

import random

import pytest

from scriptorium.operators import hierarchy as H
from scriptorium.operators.components import connected_components

SCHEMA = "rfc_number int, updates array<int>, obsoletes array<int>"


def brute(links: dict[int, set[int]]):
    """(roots and depths with the loop rows, reach)."""
    found, reach = set(), {}
    for start in links:
        seen, front, depth = {}, {start}, 0
        while front:
            depth += 1
            front = {d for s in front for d in links[s]} - set(seen)
            seen.update(dict.fromkeys(front, depth))
        reach[start] = seen
        found |= {(start, d, n) for d, n in seen.items() if not links[d]}
        if start in seen:
            found.add((start, -1, -1))
    return found, reach


def frame(spark, links):
    return spark.createDataFrame([(k, sorted(v), None) for k, v in links.items()], SCHEMA)


def random_links(seed: int, n: int, most: int) -> dict[int, set[int]]:
    rng = random.Random(seed)
    return {i: {rng.randrange(n) for _ in range(rng.choice([0, 1, 1, 1, most]))} for i in range(n)}


def least_paths(links):
    """(node, root, depth, path) over the least numbers, by breadth-first search."""
    _, reach = brute(links)
    rows = set()
    for node, seen in reach.items():
        for root, depth in seen.items():
            if links[root]:
                continue
            path = [node]
            while path[-1] != root:
                left = depth - len(path)
                path.append(min(d for d in links[path[-1]] if (d == root and left == 0) or (left > 0 and reach[d].get(root) == left)))
            rows.add((node, root, depth, tuple(path)))
    return rows


def check(spark, links, block_links):
    want, reach = brute(links)
    current = frame(spark, links)
    got = [tuple(r) for r in H.roots_and_depths(current, block_links=block_links).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = [tuple(r) for r in H.descendants(current, block_links=block_links).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(top, low, n) for low, seen in reach.items() for top, n in seen.items()}
    paths = [(*tuple(r)[:3], tuple(r["path"])) for r in H.paths(current, block_links=block_links).collect()]
    assert len(paths) == len(set(paths)) and set(paths) == least_paths(links)


@pytest.mark.parametrize("seed,n,most,block_links", [(5, 200, 2, 1000), (5, 200, 2, 60), (1, 12, 3, 0)])
def test_random_graphs(spark, seed, n, most, block_links):
    check(spark, random_links(seed, n, most), block_links)


@pytest.mark.parametrize("block_links", [40])
def test_long_chain_with_hub(spark, block_links):
    links = {i: {i - 1} if i else set() for i in range(70)} | {1000 + i: {69} for i in range(30)} | {2000: {2001}, 2001: {2000, 60}}
    check(spark, links, block_links)


@pytest.mark.parametrize("block_links", [60])
def test_forest_with_some_links_back(spark, block_links):
    rng = random.Random(11)
    links = {i: {rng.randrange(max(0, i - 40), i) for _ in range(rng.choice([1, 1, 1, 2]))} if i % 17 else set() for i in range(240)}
    for i in range(0, 200, 90):
        links[i] |= {i + 30}
    check(spark, links, block_links)


@pytest.mark.parametrize("seed", range(30))
def test_blocks(seed):
    """The block alone, over many small graphs with cycles."""
    from scriptorium.operators.contraction import Block

    links = random_links(seed, 5 + seed, 2)
    want, reach = brute(links)
    rows = [(s, d, 1, not links[d]) for s, ds in links.items() for d in ds if s != d]
    loops = {s for s, ds in links.items() if s in ds}
    got = set(Block(rows).distances(False)) | {(n, -1, -1) for n in loops | {n for n, _ in Block(rows).cycles()}}
    assert got == want
    whole = {(low, top, n) for low, seen in reach.items() for top, n in seen.items()}
    assert {p for p in whole if p[0] != p[1] or p[0] not in loops} == {p for p in Block(rows).pairs() if p[0] != p[1] or p[0] not in loops}


def test_dirty_lists(spark):
    rows = [(1, None, [None, 7, 7]), (2, [], []), (7, [2, 2, 99], [2]), (8, [8], None), (None, [1], None)]
    got = {tuple(r) for r in H.roots_and_depths(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2, 2), (7, 2, 1), (8, -1, -1)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.roots_and_depths(empty).count() == 0 and H.paths(empty).count() == 0 and H.descendants(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [("hub", f"h{i}") for i in range(40)] + [("solo", "solo"), (None, "x")]
    parent: dict[str, str] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    want = {x: root(x) for x in list(parent)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
