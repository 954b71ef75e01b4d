"""Evidence packs for many questions at once.

``results`` has query_id, id, rfc_number, section, heading, score, text. Each question has at most some hundred
rows, so windows by question stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import evidence_id
from scriptorium.operators.navigation import errata_by_section, hits_by_section
from scriptorium.operators.tables import first_sections, latest

PER_DOCUMENT, BUDGET = 5, 16_000


def dedup(results: DataFrame) -> DataFrame:
    """Of each question's rows of one section the best by score, then id."""
    return latest(results, ["query_id", "rfc_number", "section"], F.col("score").desc(), F.col("id"))


def ancestors(results: DataFrame) -> DataFrame:
    """(query_id, rfc_number, section, child, child_score): every strict dotted prefix of a section in the results."""
    parts = F.split("section", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return results.where(F.size(parts) > 1).select("query_id", "rfc_number", F.explode(prefixes).alias("section"), F.col("section").alias("child"), F.col("score").alias("child_score"))


def collapse(results: DataFrame) -> DataFrame:
    """Drop sections that have a descendant among the question's results. An equi anti join on prefixes."""
    return results.join(ancestors(results).select("query_id", "rfc_number", "section").distinct(), ["query_id", "rfc_number", "section"], "left_anti")


def overlap_warnings(results: DataFrame) -> DataFrame:
    """(query_id, rfc_number, section, child): each dropped section with its best descendant that stays."""
    kept = collapse(results).select("query_id", "rfc_number", F.col("section").alias("child"))
    below = ancestors(results).join(kept, ["query_id", "rfc_number", "child"], "left_semi")
    dropped = results.select("query_id", "rfc_number", "section").distinct()
    return latest(below.join(dropped, ["query_id", "rfc_number", "section"], "left_semi"), ["query_id", "rfc_number", "section"], F.col("child_score").desc(), F.col("child")).select("query_id", "rfc_number", "section", "child")


def cap(results: DataFrame, most: int = PER_DOCUMENT) -> DataFrame:
    """The best ``most`` of each document, with how many of it were left out."""
    document = Window.partitionBy("query_id", "rfc_number")
    ranked = results.withColumn("place", F.row_number().over(document.orderBy(F.col("score").desc(), F.col("section"), F.col("id")))).withColumn("omitted", F.greatest(F.count("*").over(document) - most, F.lit(0)))
    return ranked.where(F.col("place") <= most).drop("place")


def budget(results: DataFrame, chars: int = BUDGET) -> DataFrame:
    """``place`` by score, document, section, id; rows up to the first that overflows; the first always stays."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rfc_number"), F.col("section"), F.col("id"))
    sized = results.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0))).withColumn("place", F.row_number().over(order)).withColumn("used", F.sum("n_chars").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    flagged = sized.withColumn("budget_exceeded", F.max(F.col("used") > chars).over(Window.partitionBy("query_id")))
    return flagged.where((F.col("place") == 1) | (F.col("used") <= chars))


def budget_warnings(pack: DataFrame, chars: int = BUDGET) -> DataFrame:
    """(query_id, warning): a record for each question whose results didn't all fit."""
    told = F.concat(F.lit("evidence cut at "), F.lit(chars), F.lit(" characters; "), F.count("*"), F.lit(" sections kept"))
    return pack.where("budget_exceeded").groupBy("query_id").agg(told.alias("warning"))


def parent_headings(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows with ``parents``: headings of their strict dotted prefixes, outermost first; null headings left out."""
    chain = ancestors(rows.withColumn("score", F.lit(0.0)) if "score" not in rows.columns else rows).select("rfc_number", F.col("section").alias("prefix"), F.col("child").alias("section")).distinct()
    heads = first_sections(sections.select("rfc_number", "section", "heading", "ordinal", "id")).where("heading is not null").select("rfc_number", F.col("section").alias("prefix"), "heading")
    named = chain.join(heads, ["rfc_number", "prefix"]).groupBy("rfc_number", "section").agg(F.array_sort(F.collect_list(F.struct(F.length("prefix").alias("n"), F.col("heading")))).alias("x"))
    return rows.join(named.select("rfc_number", "section", F.transform("x", lambda x: x["heading"]).alias("parents")), ["rfc_number", "section"], "left").withColumn("parents", F.coalesce("parents", F.expr("cast(array() as array<string>)")))


def relation_notes(rows: DataFrame, related: DataFrame, planned: DataFrame) -> DataFrame:
    """(query_id, rfc_number, note): one for each obsoleted document unless the question wants old ones."""
    asked = rows.select("query_id", "rfc_number").distinct().join(planned.where("not include_obsolete").select("query_id"), "query_id", "left_semi")
    gone = asked.join(related.where("size(obsoleted_by) > 0").select("rfc_number", "obsoleted_by"), "rfc_number")
    return gone.select("query_id", "rfc_number", F.concat(F.lit("RFC "), F.col("rfc_number"), F.lit(" is obsoleted by RFC "), F.array_join(F.transform("obsoleted_by", lambda x: x.cast("string")), ", ")).alias("note"))


def assemble(results: DataFrame, sections: DataFrame, hits: DataFrame, errata: DataFrame, statuses: tuple[str, ...] = ("verified",), chars: int = BUDGET, most: int = PER_DOCUMENT) -> DataFrame:
    """The rows of each question's pack in order, with parents, keyword hits and errata."""
    rows = budget(cap(collapse(dedup(results)), most), chars)
    rows = parent_headings(rows, sections).withColumn("evidence", evidence_id("rfc_number", "section"))
    rows = rows.join(hits_by_section(hits).withColumnRenamed("section_id", "id"), "id", "left")
    return rows.join(errata_by_section(errata, statuses), "evidence", "left")


def pack_totals(rows: DataFrame) -> DataFrame:
    """(query_id, sections, total_chars, estimated_tokens, budget_exceeded)."""
    return rows.groupBy("query_id").agg(F.count("*").alias("sections"), F.sum("n_chars").alias("total_chars"), F.floor(F.sum("n_chars") / 4).alias("estimated_tokens"), F.max("budget_exceeded").alias("budget_exceeded"))
