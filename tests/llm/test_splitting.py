"""Pieces and paragraphs against plain loops."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import splitting as S


def naive_units(text, limit):
    found, number, block = [(0)], 0, []
    for line in text.split("\n") + [""]:
        if line.strip(" \t\r\f"):
            block.append(line)
        elif block:
            number += 1
            if len("\n".join(block).strip(" \t\r\f")) > limit:
                found.append(number)
            block = []
    return found


def check_pieces(text, limit, overlap):
    done = 0
    pieces = S.pieces_of(text, limit, overlap)
    for k, (a, b) in enumerate(pieces):
        assert 0 < b - a <= limit
        assert a <= done and (k == 0 or 0 <= done - a <= overlap)
        assert b > done
        done = b
    assert pieces[0][0] == 0 and done == len(text)
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n\t\r\fé。̈"), min_size=41, max_size=400))
def test_pieces_cover_texts(text):
    for a, b in check_pieces(text, 40, 8)[:-1]:
        window = text[a + 9 : b + 1]
        natural = b < len(text) and not text[b - 1].isspace() and text[b].isspace()
        if not natural:  # only where no word ends in the whole window
            ends = [i for i in range(a + 9, min(a + 40, len(text) - 1) + 1) if i < len(text) and not text[i - 1].isspace() and text[i].isspace() and text[i] not in "\x1c"]
            assert not ends, (text, a, b, window)


def test_strongest_boundary_wins_and_ties_go_right():
    text = "aa aa. aa\naa\n\naa aa aa aa aa aa aa aa"
    assert S.pieces_of(text, 20, 2)[0] == (0, 12)  # the paragraph end, not a later word
    assert S.pieces_of("aa " * 20, 20, 0)[0] == (0, 20)


def test_no_boundary_and_long_text():
    assert check_pieces("x" * 5000, 2000, 200)[0] == (0, 2000)
    assert len(check_pieces("word " * 200_000, 2000, 200)) > 500
    assert check_pieces(" " * 4001, 2000, 200)


@pytest.mark.parametrize("limit,overlap", [(1, 0), (10, 6), (10, -1)])
def test_bad_sizes(spark, limit, overlap):
    with pytest.raises(ValueError):
        S.split_oversized(spark.createDataFrame([], "id string, text string, section string"), limit=limit, overlap=overlap)


def test_table(spark, data):
    rows = [(r["id"], r["text"]) for r in spark.read.parquet(f"{data}/rfc_sections.parquet").collect()]
    rows += [("n", None), ("e", ""), ("s", "x" * 2000), ("l", "y" * 2001), ("t", "a\n\n" + "b " * 1500 + "\n \t\nc")]
    frame = spark.createDataFrame([(i, t, "1", 5, "own") for i, t in rows], "id string, text string, section string, piece_no int, para_no string")
    want = {(i, n) for i, t in rows if t and len(t) > 2000 for n in naive_units(t, 2000)}
    assert {tuple(r) for r in S.oversized_units(frame).collect()} == want
    texts = dict(rows)
    pieces = S.split_oversized(frame).collect()
    assert {r["id"] for r in pieces} == {i for i, _ in want}
    assert all(texts[r["id"]][r["start"] : r["end"]] == r["text"] and len(r["text"]) <= 2000 for r in pieces)
    assert S.split_oversized(frame.limit(0)).count() == 0
