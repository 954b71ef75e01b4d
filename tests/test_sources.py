"""Files to tables: discovery, parsing, embedding, snapshots, the engine and its command line."""

from __future__ import annotations

import json
import os
import sys
from datetime import datetime, timezone

import pytest
from pyspark import cloudpickle

from scriptorium.api import Engine, guarded
from scriptorium.config import Options
from scriptorium.operators import embedding as E
from scriptorium.operators import parsing as P
from scriptorium.session import stage_table
from scriptorium.sources import files as S
from scriptorium.sources.json_files import read_errata, read_questions
from scriptorium.sources.store import Store
from scriptorium.sources.traces import TraceSink, read_traces
from scriptorium.streaming.traces import stream_traces, windowed_counts

TEXT = """Network Notes                                   A. Writer
Updates: 12, RFC 34                              May 2020
Category: Standards Track

          The Sample
          Protocol

Status of This Memo

   This memo is a test.

Abstract

   Words.

Table of Contents

   1. Introduction
   2. Rules

1.  Introduction

   The client MUST NOT send.  It MUST wait.
   [Page 1]
RFC 7 Sample May 2020
   It may stop.

2.  Rules

   alpha = beta / gamma
      / delta
   beta =/ "x"
   prose here

2.1.  Empty

Appendix A.  Notes

   End.
"""


@pytest.fixture(scope="module")
def mirror(tmp_path_factory):
    root = tmp_path_factory.mktemp("mirror")
    (root / "sub").mkdir()
    (root / "rfc7.txt").write_text(TEXT)
    (root / "sub" / "rfc7.txt").write_text("other")
    (root / "RFC8.TXT").write_bytes(b"RFC 8\n\n1.  Only\n\n   bad \xff byte\0 SHOULD stay\n")
    (root / "notes.txt").write_text("no number")
    (root / "rfc9.xml").write_text('<rfc xmlns="u" category="info"><front><title>X  Title</title><author fullname="A. B"/><date year="2021"/></front><middle><section><name>One</name><t>first</t><section title="Sub"><t>a</t><t>b</t></section></section><section><name>Gap</name></section><section><name>Three</name><t>last</t></section></middle><back><section><t>no</t></section></back></rfc>')
    (root / "rfc7.xml").write_text("<rfc/>")
    return str(root)


def vectors():
    return lambda texts: [[float(len(t)), 1.0, 2.0, 3.0] for t in texts]


def test_discovery(spark, mirror):
    rows = {r["rfc_number"]: r for r in S.discover(spark, mirror).collect()}
    assert set(rows) == {7, 8} and rows[7]["source_path"] == "rfc7.txt" and len(rows[7]["source_sha256"]) == 64
    assert "�" in rows[8]["text"] and "\0" not in rows[8]["text"]
    both = {r["rfc_number"]: r["is_xml"] for r in S.discover(spark, mirror, "xml").collect()}
    assert both == {7: False, 8: False, 9: True}


def test_header():
    assert P.title_of(TEXT, 7) == "The Sample           Protocol"
    assert P.title_of("nothing", 7) == "RFC 7"
    assert P.numbers_of("793, RFC 12, 4234 Author, x, -1, 0") == [793, 12, 4234]
    assert P.category_of(P.header_fields(TEXT)) == "Standards Track" and P.category_of({}) is None
    assert P.without_front_matter(TEXT).startswith("Abstract")
    assert P.without_front_matter("plain") == "plain"
    assert P.authors_of(P.header_fields("Authors: A. B, C. D\n next")) == ["A. B", "C. D"]


def test_xml():
    found = S.parse_xml('<rfc><middle><section><t>x</t></section><section/><section><name>N</name><t>y</t></section></middle></rfc>')
    assert [s[0] for s in found["sections"]] == ["1", "3"]
    assert S.parse_xml("<rfc>")["sections"] == [] and S.parse_xml("")["title"] == ""


def test_grammar_and_keywords(spark):
    rows = spark.createDataFrame([("s", 1, "2", "H\n a = b\n   / c\n\n   no\n d = MUST NOT MUST\r\n"), ("n", 1, "3", None), ("e", 1, "4", "")], "id string, rfc_number int, section string, text string")
    blocks = P.grammar_blocks(rows).orderBy("block_no").collect()
    assert [(b["abnf_text"], b["rule_names"]) for b in blocks] == [(" a = b\n   / c", ["a"]), (" d = MUST NOT MUST", ["d"])]
    assert [(r["keyword"], r["line_offset"]) for r in P.keyword_hits(rows).collect()] == [("MUST NOT", 5), ("MUST", 5)]


def test_grammar_styles(spark):
    rows = spark.createDataFrame([(1, "a = b\nb = c"), (2, "struct {\n enum {"), (3, "g = { x }"), (4, "Foo ::= BAR"), (5, "prose"), (5, None)], "rfc_number int, text string")
    got = {r["rfc_number"]: r["grammar_style"] for r in P.grammar_styles(rows).collect()}
    assert got == {1: "abnf", 2: "tls-presentation-lang", 3: "cddl", 4: "asn.1", 5: "none"}


def test_index_search_and_incremental(spark, mirror, tmp_path):
    errata = tmp_path / "errata.json"
    errata.write_text(json.dumps([{"errata_id": "5", "doc-id": "RFC0007", "errata_status_code": "Verified", "section": "1", "orig_text": "wait", "correct_text": "go", "submit_date": "2020-01-02"}, {"errata_id": ""}, 3]))
    options = Options(store_path=str(tmp_path / "store"), mirror_path=mirror, parser="xml", embedding_dimensions=4, errata_path=str(errata))
    engine = Engine(spark, options, provider=vectors())
    first = engine.index()
    assert first["indexed"] == 3 and first["documents"] == 3
    names = [r["section"] for r in engine.contents(7).orderBy("position").collect()]
    assert names == ["1", "2", "2.1", "Appendix A"]
    body = engine.section(7, "1").first()
    assert body["heading"] == "Introduction" and "[Page" not in body["text"] and "RFC 7 Sample" not in body["text"]
    assert [r["keyword"] for r in engine.keyword_search("must not").collect()] == ["MUST NOT"]
    assert engine.metadata(7).first()["updates"] == [12, 34]
    before = {r["id"] for r in engine.tables["rfc_sections"].select("id").collect()}
    parts = sorted(os.listdir(options.store_path))
    again = engine.index()
    assert sorted(os.listdir(options.store_path)) == parts  # nothing changed: a manifest row and no table
    assert again["indexed"] == 0 and engine.tables["index_manifest"].count() == 2
    assert {r["id"] for r in engine.tables["rfc_sections"].select("id").collect()} == before
    assert engine.index(only=8, force=True)["indexed"] == 1
    with pytest.raises(LookupError):
        engine.index(only=4711)
    assert engine.tables["rfc_errata"].count() == 1
    stats = engine.stats().first()
    assert (stats["documents"], stats["errata"]) == (3, 1)
    store = Store(spark, options.store_path)
    store.backup(str(tmp_path / "backup"))
    other = Store(spark, str(tmp_path / "other"))
    other.restore(str(tmp_path / "backup"), mirror_path="x")
    assert other.table("rfc_sections").count() == first["sections"]
    few = Store(spark, options.store_path, most_parts=2)
    rows = store.table("rfc_sections").where("rfc_number = 8")
    for _ in range(3):
        few.publish(few.write({"rfc_sections": rows}, {"rfc_number": rows.select("rfc_number")}), mirror_path="m")
    assert max(len(parts) for parts in few.layout().values()) <= 2
    assert few.table("rfc_sections").count() == first["sections"] and few.table("indexed_rfcs").count() == 2
    assert engine.index()["indexed"] == 1 and few.table("indexed_rfcs").count() == 3
    found = Engine(spark, options, provider=vectors()).search("client sends", 3).collect()
    assert found and store.table("postings").where("lexeme = 'client'").count() == 1


def test_engine_over_tables(spark, data):
    import numpy as np

    engine = Engine.over_folder(spark, data, provider=lambda texts: [list(np.ones(64)) for _ in texts])
    known = engine.tables["rfc_sections"].where("section rlike '^[0-9]+$' and length(text) > 60 and rfc_number > 999").orderBy("rfc_number", "section").first()
    number, name = known["rfc_number"], known["section"]
    found = engine.search(f"quorum threshold in RFC {number} section {name}", 5).orderBy("rank").collect()
    assert 0 < len(found) <= 5 and found[0]["rfc_number"] == number and found[0]["score"] == 1.0
    reply = json.dumps({"answer": f"It says so [{number}#{name}].", "citations": [{"evidenceId": f"{number}#{name}", "relevantText": known["text"][:40]}]})
    asked = engine.ask(f"what does RFC {number} section {name} say", lambda system, prompt: reply)
    assert asked["pack"].count() > 0 and asked["answers"].count() == 1
    silent = engine.ask("what is it", lambda system, prompt: "not json")
    assert silent["answers"].first()["no_answer"]
    sets = engine.questions(f"RFC {number} section {name}").selectExpr("query_id", "query", "vector", f"array({number}) as documents", f"array('{name}') as sections")
    assert engine.evaluate(sets)["summary"].first()["hit_rate"] == 1.0
    assert engine.document(number)["contents"].count() > 0
    assert guarded(engine.search, " ")["is_error"]


def test_batch_is_searched_as_alone(spark, data):
    """Each question of a batch gets the filter of its own suggested keyword."""
    engine = Engine.over_folder(spark, data, provider=lambda texts: [[float(1 + (len(t) * k) % 7) for k in range(64)] for t in texts])
    texts = ["is the timeout required", "is reuse of a token allowed", "what is forbidden for a session", "quorum threshold of a cluster"]

    def rows(frame):
        return {(r["id"], r["rank"], r["score"]) for r in frame.collect()}

    batch = stage_table(engine.search(engine.questions(*texts), 8))
    for k, text in enumerate(texts):
        assert rows(batch.where(f"query_id = {k}")) == rows(engine.search(text, 8)) != set()
    held = engine.tables["normative_occurrences"].where("keyword = 'MAY'").select("section_id")
    assert batch.where("query_id = 1").join(held, batch["id"] == held["section_id"], "left_anti").count() == 0
    assert engine.search(engine.questions("x").limit(0), 8).count() == 0


def test_embedding():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise E.Retryable("busy", "0")
        return [] if len(texts) > 1 else [[]] if texts[0] == "" else [[1.0, 2.0]]

    assert E.embed_batch(flaky, ["a", ""], 2, sleep=lambda s: None) == [[1.0, 2.0], [0.0, 0.0]]
    with pytest.raises(ValueError):
        E.embed_batch(lambda t: [[1.0]], ["a"], 2)
    with pytest.raises(E.Retryable):
        E.embed_batch(lambda t: [[1.0, 2.0]] * 2, ["a"], 2, sleep=lambda s: None)
    assert E.delay(1, "7") == 7 and E.delay(1, "900") == 30 and E.delay(9, None, roll=lambda: 1.0) == 30
    assert E.delay(1, "Wed, 01 Jan 2020 00:00:10 GMT", datetime(2020, 1, 1, tzinfo=timezone.utc)) == 10
    assert E.is_retryable(429) and E.is_retryable(503) and E.is_retryable(None) and not E.is_retryable(400)


def test_vocabulary_vectors(spark):
    rows = spark.createDataFrame([("tls handshake",), (None,)], "t string")
    got = [r[0] for r in rows.select(E.vocabulary_vector("t")).collect()]
    assert sum(x * x for x in got[0]) == pytest.approx(1.0) and not any(got[1])


def test_json_sources(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    assert read_errata(spark, str(bad)).count() == 0 and read_errata(spark, str(tmp_path / "none")).count() == 0
    bad.write_text('{"Errata": [{"EID": 1, "rfc": 2, "status": "odd one", "submit_date": "x"}]}')
    assert [r["status"] for r in read_errata(spark, str(bad)).collect()] == ["odd_one"]
    asked = tmp_path / "q.json"
    asked.write_text('[{"id": "a", "Question": "x", "expectedRfcs": [1], "corpus": "full"}, {"query": "y"}]')
    assert read_questions(spark, str(asked)).count() == 2 and read_questions(spark, str(asked), "full").count() == 1


def test_options():
    assert len(Options(embedding_batch_size=0, embedding_dimensions=99_999).failures()) == 3
    with pytest.raises(ValueError):
        Options().validate()


def test_traces(spark, tmp_path):
    sink = TraceSink(str(tmp_path / "traces"))
    assert sink.put({"traceId": "1", "question": "q", "timestampUtc": "2024-01-01T10:20:00Z", "warningCount": 2})
    sink.close()
    rows = read_traces(spark, str(tmp_path / "traces"))
    assert rows.first()["warningCount"] == 2
    assert windowed_counts(rows, "timestampUtc", "question").first()["n"] == 1
    query = windowed_counts(stream_traces(spark, str(tmp_path / "traces")), "timestampUtc", "question").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("counts").first()["n"] == 1


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import the tests
MODEL_REPLY = json.dumps({"answer": "It says so [9#9].", "citations": []})


def model(system, prompt, tokens):
    assert tokens == 7 or tokens == 1_024
    return MODEL_REPLY


def test_traces_and_retrieval_info(spark, data, tmp_path):
    options = Options(store_path=data, trace_directory=str(tmp_path / "traces"), answer_tokens=7)
    engine = Engine.over_folder(spark, data, options, E.vocabulary_provider(64))
    told = engine.ask(engine.questions("what is forbidden in RFC 1234", "quorum threshold"), model, 5)
    info = {r["query_id"]: r["retrieval"] for r in told["retrieval"].collect()}
    assert info[0]["filters"]["normative_keyword"] == "MUST NOT" and info[0]["plan"]["rfc_numbers"] == [1234] and info[1]["strategy"] == "query-planner"
    rows = read_traces(spark, options.trace_directory).orderBy("question").collect()
    assert [r["question"] for r in rows] == ["quorum threshold", "what is forbidden in RFC 1234"]
    assert [s["name"] for s in rows[0]["stages"]] == ["search", "assemble", "generate"] and rows[0]["answerGenerated"] and rows[0]["candidateRfcNumbers"]
    told = engine.ask("quorum", model, 5, include_errata=False)
    assert told["errata"].count() == 0 and told["budget"].columns == ["query_id", "warning"]


def test_lexical_search_alone_is_asked_for(spark, data):
    engine = Engine.over_folder(spark, data)
    with pytest.raises(ValueError):
        engine.search("quorum")
    lexical = Engine.over_folder(spark, data, Options(store_path=data, embedding_model="none"))
    assert lexical.search("quorum threshold", 3).count() > 0
    with pytest.raises(ValueError):
        lexical.reset_embeddings()


def test_embeddings_are_counted(spark, mirror, tmp_path):
    engine = Engine(spark, Options(store_path=str(tmp_path / "store"), mirror_path=mirror, embedding_dimensions=4), provider=vectors())
    assert engine.index()["embedding_batches"] >= 2
    assert engine.reset_embeddings(confirm=True)["indexed"] == 2


def test_command_line(spark, data, mirror, tmp_path, capsys):
    from scriptorium.__main__ import main

    asked = tmp_path / "q.json"
    asked.write_text('[{"id": "a", "question": "quorum threshold", "expectedRfcs": [1], "mustCite": [1], "answerType": "factual"}]')
    base = ["--store", data, "--tables", "--provider", "vocabulary", "--model", "test_sources:model", "--limit", "3"]
    assert main([*base, "ask", "quorum threshold"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["answers"][0]["no_answer"] and told["retrieval"][0]["retrieval"]["strategy"] == "query-planner"
    assert main([*base, "--answers", "eval", str(asked)]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["summary"][0]["questions"] == 1 and told["answer_summary"][0]["answers"] == 1 and "latency_ms" in told["summary"][0]
    assert main([*base, "search", "quorum threshold"]) == 0 and len(capsys.readouterr().out.splitlines()) == 3
    store = ["--store", str(tmp_path / "store"), "--mirror", mirror, "--provider", "vocabulary", "--dimensions", "8"]
    assert main([*store, "index"]) == 0 and json.loads(capsys.readouterr().out)["documents"] == 2
    assert main([*store, "--reset-embeddings", "index"]) == 1 and "confirm" in capsys.readouterr().err
    assert main([*store, "--reset-embeddings", "--confirm", "index"]) == 0
    capsys.readouterr()
    assert main([*store, "search", "bad state"]) == 0 and main(["--store", data, "--tables", "ask", "x"]) == 1
