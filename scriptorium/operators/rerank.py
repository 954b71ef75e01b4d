"""Deterministic rerank of fused candidates (Q09, Q10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import query_terms
from scriptorium.operators.relations import status
from scriptorium.operators.retrieval import clamp, in_place, top

# Weights of the signals.
MENTIONED, SECTION_NAMED, PROTOCOL, HEADING, OBSOLETED, SUCCESSOR = 0.12, 0.10, 0.04, 0.05, -0.10, 0.06


def scored(candidates: DataFrame, planned: DataFrame, sections: DataFrame, related: DataFrame) -> DataFrame:
    """Q10: candidates (query_id, id, rrf) with the section's columns, the relations' columns and ``score``.

    Candidates are a few hundred rows a question, so they are joined to sections and relations by key; the plan's
    arrays travel with them.
    """
    rows = (
        candidates.join(sections.select("id", "rfc_number", "section", "heading"), "id")
        .join(planned.select("query_id", "rfc_numbers", "section_references", "protocol_numbers", "include_obsolete", query_terms("query").alias("terms")), "query_id")
        .join(related, "rfc_number", "left")
    )
    none = F.expr("cast(array() as array<int>)")
    gone = F.size(F.coalesce("obsoleted_by", none)) > 0
    linked = F.concat(F.coalesce("obsoletes", none), F.coalesce("updates", none))
    heading = F.lower(F.coalesce("heading", F.lit("")))
    signals = [
        (F.array_contains("rfc_numbers", F.col("rfc_number")), MENTIONED),
        (F.exists("section_references", lambda r: (r["rfc_number"] == F.col("rfc_number")) & (r["section"] == F.col("section"))), SECTION_NAMED),
        (F.array_contains("protocol_numbers", F.col("rfc_number")), PROTOCOL),
        (F.exists("terms", lambda t: F.contains(heading, t)), HEADING),
        (~F.col("include_obsolete") & gone, OBSOLETED),
        (F.arrays_overlap("rfc_numbers", linked), SUCCESSOR),
    ]
    total = F.col("rrf")
    for test, weight in signals:
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return rows.withColumn("score", F.round(total, 6)).withColumn("category", status())


def rerank(candidates: DataFrame, planned: DataFrame, sections: DataFrame, related: DataFrame, limit: int = 10) -> DataFrame:
    """Q09: the best ``limit`` of each question by score, document, section and id."""
    rows = scored(candidates, planned, sections, related)
    best = top(rows, clamp(limit), F.col("score").desc(), *in_place())
    return best.select("query_id", "id", "rfc_number", "section", "heading", "rrf", "score", "category", "rank")
