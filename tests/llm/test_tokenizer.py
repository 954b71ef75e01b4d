"""Encoding against an independent implementation, on odd texts and on the test tables."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import tokenizer as K

tokenizers = pytest.importorskip("tokenizers")
PATH = os.path.join(K.DEFAULT_PATH, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def other():
    found = tokenizers.Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


def ours(texts):
    ids, sizes = K.Encoder(PATH).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


ODD = ["", " ", "   ", "'s", "a's b'll  'x\n\n 's", "''s it's'", "a" * 3001, "<|endoftext|> x", "\t\ta  b \n c\n", " ​　x", "1'd 2'm've", "don'tabc'rex", "\x1c\x1d a", "\U0001f468‍\U0001f469", " '", "a 's", "\r\n\r\n x", "½²Ⅷ á", "日本語のテキスト。", "aaaabaaaab" * 9, "\u0000", "'re'RE 'S"]


def test_odd_texts(other):
    assert ours(ODD) == [other(t) for t in ODD]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sretvmld \n\t1é日!<|>"), max_size=30), max_size=5))
def test_random_texts(texts):
    found = tokenizers.Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    assert ours(texts) == [found.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_one_hash_keep_their_ids(other):
    encoder = K.Encoder(PATH)
    encoder.hash = lambda points, start, end: K.span_hash(points, start, end) % np.uint64(5)
    for texts in (ODD, ["many words that share few hashes, again and again"] * 2 + ODD):
        ids, sizes = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [other(t) for t in texts]


def test_forgets_and_stays_right(other):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(30)]
    encoder = K.Encoder(PATH, keep=20)
    for t in texts:
        assert encoder.encode([t])[0].tolist() == other(t)


def test_tables(spark, data, other):
    from scriptorium.llm.queries import p6_ids

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = p6_ids(spark, data).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row["ids"] == (other(texts[row["doc_id"]]) if texts[row["doc_id"]] else [])


def test_null_empty_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi", "x"), (3, "hi", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in K.encode_corpus(rows).collect())
    assert [g[0] for g in got] == [1, 2, 3, 3] and got[0][1] == () and got[1][1] == () and got[2] == got[3]
    counts = {r["doc_id"]: r["n_tokens"] for r in K.token_counts(rows).collect()}
    assert counts == {1: 0, 2: 0, 3: len(got[2][1])}
    assert K.encode_corpus(rows.limit(0)).count() == 0
