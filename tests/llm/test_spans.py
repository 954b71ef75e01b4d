"""Shared spans against a set of all windows, by every path."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from scriptorium.llm.automaton import SuffixAutomaton
from scriptorium.llm.spans import shared_spans


def brute(rows, least):
    held = defaultdict(set)
    for key, text in rows:
        for i in range(len(text or "") - least + 1):
            held[text[i : i + least]].add(key)
    found = defaultdict(set)
    for key, text in rows:
        for i in range(len(text or "") - least + 1):
            if len(held[text[i : i + least]]) > 1:
                found[key].update(range(i, i + least))
    return {k: len(v) for k, v in found.items() if v}


def made(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd é") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    rows = [(f"k{i:03}", "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("xyz") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8)))) for i in range(n)]
    return rows + [("null", None), ("empty", ""), ("short", "ab"), ("runs1", "=" * 300), ("runs2", "=" * 90 + "!"), ("again", rows[0][1]), ("self", "q1w2e3r4" * 30)]


@pytest.mark.parametrize("options", [{}, {"automaton_chars": 300}, {"automaton_chars": 1}], ids=["shards", "blocks", "a piece a block"])
def test_against_windows(spark, options):
    rows = made(3)
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "id string, text string, start int, shard string").repartition(5)
    got = {r["id"]: r["shared_chars"] for r in shared_spans(frame, least=40, anchor=16, **options).collect()}
    assert got == brute(rows, 40)


def test_repeated_ids_and_empty_tables(spark):
    text = "the same words again and again " * 4
    rows = spark.createDataFrame([("a", text), ("a", text), (None, text)], "id string, text string")
    assert shared_spans(rows, least=40).count() == 0
    assert shared_spans(rows.limit(0)).count() == 0
    spans = shared_spans(spark.createDataFrame([("a", text), ("b", "!" + text)], "id string, text string"), least=40).orderBy("id").collect()
    assert [(s["start"], s["end"]) for r in spans for s in r["spans"]] == [(0, len(text)), (1, len(text) + 1)]


def test_automaton_random():
    rng = random.Random(9)
    for _ in range(200):
        texts = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(4)})
        machine = SuffixAutomaton(texts, range(len(texts)), range(len(texts)))
        for i, text in enumerate(texts):
            others = [t for j, t in enumerate(texts) if j != i]
            want = set()
            for a in range(len(text) - 3):
                if any(text[a : a + 4] in t for t in others):
                    want.update(range(a, a + 4))
            got = {x for s, e in machine.foreign_spans(text, i, 4) for x in range(s, e)}
            assert got == want, (texts, text)
