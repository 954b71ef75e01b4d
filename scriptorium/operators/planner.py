"""Question planner as columns (N01-N06): what a question mentions, before any retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.schema import KEYWORD_PATTERN, PROTOCOL_SEEDS

MENTION = r"(?i)\bRFC\s*(\d{3,5})\b"
REFERENCE = r"(?is)\bRFC\s*(\d{3,5})\b.{0,80}?(?:\bsection\s+|§\s*)(\d+(?:\.\d+)*[A-Za-z]?)\b"
PROTOCOLS = r"(?i)\b(" + "|".join(PROTOCOL_SEEDS) + r")\b"


def mentions(query: Column | str) -> Column:
    """Numbers mentioned, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(MENTION), F.lit(1)), lambda x: x.cast("int")))


def section_references(query: Column | str) -> Column:
    """(rfc_number, section) where a section follows a mention within 80 characters."""
    numbers, names = (F.regexp_extract_all(query, F.lit(REFERENCE), F.lit(g)) for g in (1, 2))
    return F.array_distinct(F.zip_with(numbers, names, lambda n, s: F.struct(n.cast("int").alias("rfc_number"), s.alias("section"))))


def suggested_keyword(query: Column | str) -> Column:
    """None if the question names a keyword in capitals itself."""
    query = F.col(query) if isinstance(query, str) else query
    return (
        F.when(query.rlike(KEYWORD_PATTERN), F.lit(None).cast("string"))
        .when(query.rlike(r"(?i)\b(forbidden|must\s+not)\b"), "MUST NOT")
        .when(query.rlike(r"(?i)\b(must|required|compliant)\b"), "MUST")
        .when(query.rlike(r"(?i)\ballowed\b"), "MAY")
    )


def protocol_documents(query: Column | str) -> Column:
    """Sorted distinct documents of the protocols named."""
    seeds = F.create_map(*(x for name, numbers in PROTOCOL_SEEDS.items() for x in (F.lit(name), F.array(*map(F.lit, numbers)))))
    named = F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(PROTOCOLS), F.lit(1)), lambda x: F.lower(x)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(named, lambda x: seeds[x]))))


def plan(questions: DataFrame, query: str = "query") -> DataFrame:
    """The questions with their plan; a null question plans nothing."""
    text = F.coalesce(F.col(query), F.lit(""))
    planned = (
        questions.withColumn("rfc_numbers", mentions(text))
        .withColumn("section_references", section_references(text))
        .withColumn("protocol_numbers", protocol_documents(text))
        .withColumn("suggested_keyword", suggested_keyword(text))
        .withColumn("grammar_intent", text.rlike(r"(?i)\b(ABNF|grammar|syntax|Augmented\s+BNF)\b"))
        .withColumn("include_obsolete", text.rlike(r"(?i)\b(old|obsolete|changed\s+from)\b"))
        .withColumn("needs_current", ~F.col("include_obsolete"))
    )
    tags = [
        (F.size("rfc_numbers") > 0, "rfc-number"),
        (F.size("section_references") > 0, "section-reference"),
        (F.col("suggested_keyword").isNotNull(), "normative-keyword"),
        (F.size("protocol_numbers") > 0, "protocol-hint"),
        (F.col("grammar_intent"), "abnf-intent"),
        (F.col("include_obsolete"), "historical-intent"),
    ]
    return planned.withColumn("rationale", F.array_compact(F.array(*(F.when(test, F.lit(tag)) for test, tag in tags))))
