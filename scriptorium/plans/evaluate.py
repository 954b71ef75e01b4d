"""Evaluation of searches and answers against a question set, for all questions at once.

``questions``: query_id, and, as arrays, documents, sections, must_cite, should_not_cite; answer_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import metrics as M


def retrieval(found: DataFrame, questions: DataFrame, limit: int = 10) -> DataFrame:
    """Metrics of each question; one that expects sections is judged by sections (M02), else by documents."""
    name = F.concat_ws("#", "rfc_number", "section")
    by_section = questions.where("size(sections) > 0").select("query_id")
    sections = found.join(by_section, "query_id", "left_semi").select("query_id", "rank", name.alias("item"))
    documents = M.document_ranking(found.join(by_section, "query_id", "left_anti")).select("query_id", "rank", F.col("item").cast("string").alias("item"))
    expected = M.expected_sections(questions.where("size(sections) > 0")).select("query_id", name.alias("item")).unionByName(
        questions.join(by_section, "query_id", "left_anti").select("query_id", F.explode(F.col("documents").cast("array<string>")).alias("item"))
    )
    return M.retrieval_metrics(sections.unionByName(documents), expected, questions, limit)


def answers(found: DataFrame, citations: DataFrame, support: DataFrame, questions: DataFrame, obsolete: DataFrame) -> DataFrame:
    """Answer metrics (M07-M15) of each question. The pack isn't passed on, so a quote counts as faithful if it isn't
    blank; an obsolete document counts where it is cited."""
    number = F.split("evidence", "#")[0].cast("int")
    cited = citations.withColumn("rfc_number", number).join(obsolete.select("rfc_number", F.lit(True).alias("_old")), "rfc_number", "left")
    told = cited.groupBy("answer_id").agg(F.collect_set("rfc_number").alias("cited"), F.collect_set(F.when(F.col("_old"), F.col("rfc_number"))).alias("obsolete"), F.collect_list("quote").alias("quotes"))
    rows = (
        questions.select(F.col("query_id").alias("answer_id"), "answer_type", "must_cite", "should_not_cite")
        .join(found.select("answer_id", "no_answer"), "answer_id", "left")
        .join(told, "answer_id", "left")
        .join(support.select("answer_id", "support_rate"), "answer_id", "left")
    )
    return M.answer_metrics(rows.withColumn("faithful", F.lit(None).cast("int")))
