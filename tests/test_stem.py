"""Stems: the published examples, and the function against its SQL twin."""

from __future__ import annotations

import duckdb
import pytest

from scriptorium.functions.stem import stem_of, stem_sql, with_stems
from scriptorium.operators import retrieval as Q

EXAMPLES = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "fizzed": "fizz", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "rational": "ration", "digitizer": "digit", "operator": "oper", "decisiveness": "decis", "hopefulness": "hope", "sensibiliti": "sensibl", "formative": "form",
    "electrical": "electr", "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "connections": "connect", "connection": "connect", "yes": "ye", "x25s": "x25s", "is": "is", "tls": "tl",
}


def test_examples():
    assert {w: stem_of(w) for w in EXAMPLES} == EXAMPLES


def test_twin(data):
    link = duckdb.connect()
    link.execute(f"create table words as select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from '{data}/rfc_sections.parquet'")
    rows = link.execute(stem_sql("words")).fetchall()
    assert len(rows) > 500 and all(stem_of(word) == stem for word, stem in rows)


def test_null_words(spark):
    assert [r["lexeme"] for r in with_stems(spark.createDataFrame([(None,), ("words",)], "word string"), "word").collect()] == [None, "word"]


def test_forms_of_a_word_meet(spark):
    rows = spark.createDataFrame([("a", 2, "1", "Connections close."), ("b", 1, "1", "a connected peer closes the connection"), ("c", 1, "1", None)], "id string, rfc_number int, section string, text string")
    asked = spark.createDataFrame([(1, "connection closing"), (2, "the of"), (3, None)], "query_id int, query string")
    for index in (Q.postings(rows), Q.postings(rows, questions=asked)):
        got = Q.lexical_search(asked, index).orderBy("rank").collect()
        assert [(r["query_id"], r["id"]) for r in got] == [(1, "b"), (1, "a")]
    assert got[0]["score"] > got[1]["score"]


@pytest.mark.parametrize("limit", [1, 2])
def test_equal_scores_go_by_document_and_section(spark, limit):
    rows = spark.createDataFrame([("a", 2, "1", "token"), ("z", 1, "2", "token"), ("b", 1, "10", "token")], "id string, rfc_number int, section string, text string")
    asked = spark.createDataFrame([(1, "tokens", [1.0] * 64)], "query_id int, query string, vector array<double>")
    assert [r["id"] for r in Q.lexical_search(asked, Q.postings(rows), limit).orderBy("rank").collect()] == ["b", "z"][:limit]
    vectors = rows.selectExpr("id", "rfc_number", "section", "array_repeat(2.0D, 64) as vector")
    assert [r["id"] for r in Q.vector_search(asked, vectors, limit).orderBy("rank").collect()] == ["b", "z"][:limit]
    assert [r["id"] for r in Q.hybrid_search(asked, Q.postings(rows), vectors, rows, 3).orderBy("rank").collect()] == ["a", "b", "z"]


def test_substrings_through_grams(spark):
    blocks = spark.createDataFrame([("x", "Rule = %x41 / Beta"), ("y", "be"), ("z", None), ("w", "")], "id string, abnf_text string")
    asked = spark.createDataFrame([(1, "= %X"), (2, "b"), (3, "be"), (4, " "), (5, None), (6, "nowhere"), (7, "rule = %x41 / beta")], "query_id int, query string")
    assert {tuple(r) for r in Q.holding(asked, blocks).collect()} == {(1, "x"), (2, "x"), (2, "y"), (3, "x"), (3, "y"), (7, "x")}


def test_scan_equals_the_inverted_table(spark):
    """The best rows straight from the texts, stored nowhere: sets asked for twice, ties of scores, null places, no lexemes."""
    texts = ["token rules", "rules of tokens", "tokens tokens rule", "nothing", None, "", "the token", "Rule TOKEN token"] * 3
    rows = spark.createDataFrame([(f"s{i:02}", None if i % 7 == 0 else i % 5, None if i % 6 == 0 else str(i % 3), t) for i, t in enumerate(texts)], "id string, rfc_number int, section string, text string")
    asked = spark.createDataFrame([(1, "token rules"), (2, "rule and the tokens"), (3, "the of"), (4, "tokens"), (5, "token absent"), (6, None)], "query_id int, query string")
    index = Q.postings(rows)
    for limit in (2, 10):
        want = Q.lexical_search(asked, index, limit).select("query_id", "id", "rfc_number", "section", "score", "rank").collect()
        assert {r["query_id"] for r in want} == {1, 2, 4} and sorted(map(str, Q.scan_best(asked, rows.repartition(5), limit).collect())) == sorted(map(str, want))
    best = Q.top(Q.bm25_matches(asked, index), 4, Q.F.col("score").desc(), Q.F.col("id")).select("query_id", "id", "score", "rank").collect()
    assert sorted(map(str, Q.scan_best(asked, rows.repartition(5), 4, "bm25").select("query_id", "id", "score", "rank").collect())) == sorted(map(str, best))
    assert Q.scan_best(asked.where("query_id = 3"), rows, 5).count() == 0


def test_queries_of_the_best_rows_store_no_postings(spark, data, monkeypatch):
    from scriptorium.plans import inputs
    from scriptorium.plans.registry import QUERIES

    monkeypatch.setattr(inputs, "stored_postings", lambda rows: pytest.fail("postings are stored"))
    monkeypatch.setattr(inputs, "stage_folder", lambda spark: "/tmp/no-postings-here")
    for name in ("q01_lexical", "q01_bm25", "m02_section_hit"):
        assert QUERIES[name](spark, data).count() > 0
