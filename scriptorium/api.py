"""The engine as a Python object over a published store or a folder of tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import Options
from scriptorium.operators import embedding as E_
from scriptorium.operators import evidence as E
from scriptorium.operators import metrics as M
from scriptorium.operators import navigation as L
from scriptorium.operators import relations as R
from scriptorium.operators import retrieval as Q
from scriptorium.operators import tables as T
from scriptorium.operators.embedding import Provider
from scriptorium.operators.retrieval import clamp
from scriptorium.plans import ask as ask_plan
from scriptorium.plans import evaluate as evaluate_plan
from scriptorium.plans import index as index_plan
from scriptorium.session import stage_table
from scriptorium.sources.store import TABLES, Store
from scriptorium.sources.traces import write_traces


class Engine:
    def __init__(self, spark: SparkSession, options: Options, tables: dict[str, DataFrame] | None = None, provider: Provider | None = None) -> None:
        self.spark, self.options, self.provider = spark, options, provider
        self._tables = tables

    @classmethod
    def over_folder(cls, spark: SparkSession, folder: str, options: Options | None = None, provider: Provider | None = None) -> Engine:
        """An engine over Parquet files named like the tables."""
        tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in [*TABLES, "index_manifest"] if name != "postings"}
        return cls(spark, options or Options(store_path=folder), tables, provider)

    @property
    def tables(self) -> dict[str, DataFrame]:
        if self._tables is not None:
            found = dict(self._tables)
        else:
            store = Store(self.spark, self.options.store_path)
            found = {name: store.table(name) for name in TABLES} | {"index_manifest": store.manifest()}
        found["indexed_rfcs"] = T.current_documents(found["indexed_rfcs"])
        found["rfc_errata"] = T.current_errata(found["rfc_errata"])
        return found

    def _settings(self) -> dict:
        o = self.options
        return {"planner": o.planner, "reranker": o.reranker, "vector_only": o.vector_only, "width": o.embedding_dimensions, "factor": o.candidate_factor, "rrf": o.rrf_constant}

    def questions(self, *texts: str) -> DataFrame:
        """(query_id, query, vector) of question texts, embedded by the provider; without vectors if the options ask for
        lexical search alone (U05)."""
        if any(not t or not t.strip() for t in texts):
            raise ValueError("a question must not be blank")
        vectors = E_.embed_batch(self.needed_provider(), list(texts), self.options.embedding_dimensions) if self.needed_provider() else [None] * len(texts)
        return self.spark.createDataFrame([(i, t, None if v is None else list(map(float, v))) for i, (t, v) in enumerate(zip(texts, vectors))], "query_id int, query string, vector array<double>")

    def needed_provider(self) -> Provider | None:
        """The provider; None only if the options say that there are no embeddings."""
        if self.provider is None and self.options.embedding_model != "none":
            raise ValueError("no embedding provider; set embedding_model to none for lexical search alone")
        return self.provider

    def search(self, query: str | DataFrame, limit: int = 10, keyword: str | None = None, include_obsolete: bool = False) -> DataFrame:
        """T01; a table of questions is searched in one plan."""
        asked = self.questions(query) if isinstance(query, str) else query
        return ask_plan.search(asked, self.tables, limit, keyword, include_obsolete=include_obsolete, **self._settings())

    def document(self, number: int) -> dict[str, DataFrame]:
        """Metadata, contents and the first sections."""
        sections = self.tables["rfc_sections"].where(F.col("rfc_number") == number)
        return {"metadata": self.metadata(number), "contents": L.table_of_contents(sections), "sections": L.preview(sections)}

    def full_text(self, number: int) -> DataFrame:
        """T03."""
        return L.full_text(self.tables["rfc_sections"], number)

    def section(self, number: int, name: str, depth: int = 0, expand: bool = False) -> DataFrame:
        """The section; with a depth its immediate children too, else with ``expand`` the sections it names."""
        sections = self.tables["rfc_sections"].where(F.col("rfc_number") == number)
        one = L.section(sections, number, name)
        if depth > 0:
            kids = L.children(sections).where(F.col("parent") == name).select("rfc_number", "section")
            return one.unionByName(T.first_sections(sections).join(kids, ["rfc_number", "section"], "left_semi").select(*one.columns))
        if expand:
            # of the section's own words, against all headings of its document
            named = L.type_references(sections).join(one.select("id"), "id", "left_semi").select("rfc_number", F.col("target_section").alias("section"))
            return one.unionByName(T.first_sections(sections).join(named, ["rfc_number", "section"], "left_semi").select(*one.columns))
        return one

    def metadata(self, number: int) -> DataFrame:
        """T05."""
        return L.metadata(self.tables["indexed_rfcs"], number)

    def list(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """T06."""
        return L.listing(self.tables["indexed_rfcs"], limit, offset)

    def keyword_search(self, keyword: str, documents: list[int] | None = None, limit: int = 20) -> DataFrame:
        """T07."""
        wanted = self.spark.createDataFrame([(keyword.strip().upper(),)], "keyword string")
        return Q.keyword_search(Q.in_documents(self.tables["normative_occurrences"], documents), self.tables["rfc_sections"], wanted, limit)

    def grammar_search(self, query: str, documents: list[int] | None = None, limit: int = 20) -> DataFrame:
        """T08."""
        return Q.grammar_search(self.questions(query), Q.in_documents(self.tables["rfc_abnf_blocks"], documents), limit)

    def relations(self, number: int) -> DataFrame:
        """T09."""
        return R.relations(self.tables["indexed_rfcs"]).where(F.col("rfc_number") == number)

    def stats(self) -> DataFrame:
        """T10."""
        t = self.tables
        return T.corpus_stats(t["indexed_rfcs"], t["rfc_sections"], t["rfc_abnf_blocks"], t["normative_occurrences"], t["rfc_errata"], t["index_manifest"])

    def contents(self, number: int) -> DataFrame:
        """T11."""
        return L.table_of_contents(self.tables["rfc_sections"].where(F.col("rfc_number") == number))

    def evidence(self, query: str, budget: int = 10_000, limit: int = 20) -> DataFrame:
        """The evidence pack of a question."""
        found = self.search(query, limit)
        t = self.tables
        results = found.join(t["rfc_sections"].select("id", "text"), "id").select("query_id", "id", "rfc_number", "section", "heading", "text", "score")
        return E.assemble(results, t["rfc_sections"], t["normative_occurrences"], t["rfc_errata"], chars=budget, most=self.options.sections_per_document).orderBy("query_id", "place")

    def ask(self, query: str | DataFrame, model: ask_plan.Model, limit: int = 20, keyword: str | None = None, statuses: tuple[str, ...] = ("verified",), include_errata: bool = True, include_obsolete: bool = False) -> dict[str, DataFrame]:
        """T12; with a trace directory a trace of each question goes there."""
        asked = self.questions(query) if isinstance(query, str) else query
        o = self.options
        told = ask_plan.ask(
            asked, self.tables, model, limit, o.evidence_budget_chars, statuses, o.sections_per_document, o.answer_tokens, include_errata, keyword=keyword, include_obsolete=include_obsolete, **self._settings()
        )
        if o.trace_directory:
            write_traces(told["traces"], o.trace_directory)
        return told

    def index(self, force: bool = False, only: int | None = None) -> dict:
        """C04, S20."""
        return index_plan.index_run(self.spark, self.options, self.needed_provider(), force, only)

    def reset_embeddings(self, confirm: bool = False) -> dict:
        """Embeds and indexes every document again; refuses unless confirmed, since old vectors are lost."""
        if not confirm:
            raise ValueError("this replaces all embeddings; confirm to go on")
        return index_plan.reset_embeddings(self.spark, self.options, self.needed_provider())

    def embedded(self, questions: DataFrame) -> DataFrame:
        """The questions (query_id, query, ...) with ``vector``, by the provider."""
        provider = self.needed_provider()
        if provider is None:
            return questions.withColumn("vector", F.lit(None).cast("array<float>"))
        vectors = E_.embed(questions, provider, self.options.embedding_dimensions, "query_id", "query", self.options.embedding_batch_size, self.options.embedding_concurrency)
        return questions.join(vectors.withColumnRenamed("embedding", "vector"), "query_id")

    def evaluate(self, questions: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
        """Retrieval metrics of a question set (query_id, query, vector, documents, sections), all in one plan."""
        began = time.monotonic()
        found = stage_table(self.search(questions.select("query_id", "query", "vector"), clamp(limit)))
        each = (time.monotonic() - began) * 1000 / max(questions.count(), 1)
        metrics = evaluate_plan.retrieval(found, questions, limit).withColumn("latency_ms", F.lit(each))
        return {"questions": metrics, "summary": M.retrieval_summary(metrics, "latency_ms")}

    def evaluate_answers(self, questions: DataFrame, model: ask_plan.Model, limit: int = 10) -> dict[str, DataFrame]:
        """Retrieval metrics, and answer metrics of each question with their summary."""
        told = self.ask(questions.select("query_id", "query", "vector"), model, limit)
        answers = evaluate_plan.answers(told["answers"], told["citations"], told["support"], questions, R.obsolete_documents(self.tables["indexed_rfcs"]))
        return {**self.evaluate(questions, limit), "answers": answers, "answer_summary": M.answer_summary(answers)}


def guarded(call, *args: object, **kwargs: object) -> dict:
    """The result, or the error as data; interrupts pass through."""
    try:
        return {"is_error": False, "result": call(*args, **kwargs)}
    except Exception as failure:  # noqa: BLE001
        return {"is_error": True, "message": f"{type(failure).__name__}: {failure}"}
