"""Command line. ``python -m scriptorium --store FOLDER search "question"``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame

from scriptorium.api import Engine, guarded
from scriptorium.config import Options
from scriptorium.operators.embedding import vocabulary_provider
from scriptorium.session import build_session
from scriptorium.sources.json_files import read_questions

COMMANDS = ("search", "section", "document", "normative", "grammar", "relations", "stats", "list", "contents", "evidence", "index", "eval", "ask")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium")
    p.add_argument("--store", required=True, help="folder of a published store, or of Parquet tables with --tables")
    p.add_argument("--tables", action="store_true")
    p.add_argument("--mirror", default="")
    p.add_argument("--errata")
    p.add_argument("--parser", choices=("text", "xml"), default="text")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--rfc", type=int, action="append")
    p.add_argument("--budget", type=int, default=10_000)
    p.add_argument("--keyword")
    p.add_argument("--corpus", default="all")
    p.add_argument("--force", action="store_true")
    p.add_argument("--provider", default="none", help="none for lexical search alone, vocabulary, or MODULE:FUNCTION, a function from texts to vectors")
    p.add_argument("--dimensions", type=int, default=64)
    p.add_argument("--model", help="MODULE:FUNCTION, a function from a system text and a prompt to a reply")
    p.add_argument("--answers", action="store_true", help="with eval: judge answers too")
    p.add_argument("--reset-embeddings", action="store_true", help="with index: embed everything again")
    p.add_argument("--confirm", action="store_true")
    p.add_argument("--traces", help="folder of the daily trace files")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("words", nargs="*")
    return p


def named(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def rows(frame: DataFrame) -> list:
    return [json.loads(line) for line in frame.toJSON().toLocalIterator()]


def run(engine: Engine, a: argparse.Namespace):
    words = " ".join(a.words)
    if a.command in ("ask", "eval") and (a.command == "ask" or a.answers) and not a.model:
        raise ValueError("a model is needed; name one with --model")
    if a.command == "index":
        return engine.reset_embeddings(a.confirm) if a.reset_embeddings else engine.index(a.force, a.rfc[0] if a.rfc else None)
    if a.command == "eval":
        questions = engine.embedded(read_questions(engine.spark, a.words[0], a.corpus))
        if a.answers:
            told = engine.evaluate_answers(questions, named(a.model), a.limit)
            return {name: rows(told[name]) for name in ("summary", "answer_summary", "answers")}
        return engine.evaluate(questions, a.limit)["summary"]
    if a.command == "ask":
        told = engine.ask(words, named(a.model), a.limit, a.keyword)
        return {name: rows(told[name]) for name in ("answers", "citations", "claims", "support", "errata", "budget", "retrieval")}
    calls = {
        "search": lambda: engine.search(words, a.limit, a.keyword).orderBy("rank"),
        "section": lambda: engine.section(int(a.words[0]), a.words[1]),
        "document": lambda: engine.document(int(a.words[0]))["sections"],
        "normative": lambda: engine.keyword_search(words, a.rfc, a.limit),
        "grammar": lambda: engine.grammar_search(words, a.rfc, a.limit),
        "relations": lambda: engine.relations(int(a.words[0])),
        "stats": engine.stats,
        "list": lambda: engine.list(a.limit, a.offset),
        "contents": lambda: engine.contents(int(a.words[0])),
        "evidence": lambda: engine.evidence(words, a.budget, a.limit),
    }
    return calls[a.command]()


def engine_of(a: argparse.Namespace) -> Engine:
    spark = build_session(a.master)
    options = Options(
        store_path=a.store, mirror_path=a.mirror, errata_path=a.errata, parser=a.parser, embedding_model=a.provider, embedding_dimensions=a.dimensions, trace_directory=a.traces, evidence_budget_chars=a.budget
    )
    provider = None if a.provider == "none" else vocabulary_provider(a.dimensions) if a.provider == "vocabulary" else named(a.provider)
    return Engine.over_folder(spark, a.store, options, provider) if a.tables else Engine(spark, options, provider=provider)


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    out = guarded(run, engine_of(a), a)
    if out["is_error"]:
        print(out["message"], file=sys.stderr)
        return 1
    result = out["result"]
    if isinstance(result, dict):
        print(json.dumps(result))
    else:
        for line in result.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
