"""Lookup and navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import evidence_id, section_order
from scriptorium.operators.tables import current_errata, first_sections, latest
from scriptorium.schema import ERRATA_STATUSES


def section(sections: DataFrame, number: int, name: str) -> DataFrame:
    """One section; of several rows the first by ordinal."""
    return first_sections(sections.where((F.col("rfc_number") == number) & (F.col("section") == name)))


def in_order(sections: DataFrame) -> DataFrame:
    """``position`` of each section in its document, by dotted numbers, then others by name, then id."""
    order = Window.partitionBy("rfc_number").orderBy(*section_order(), F.col("id"))
    return sections.withColumn("position", F.row_number().over(order))


def table_of_contents(sections: DataFrame) -> DataFrame:
    """(rfc_number, position, section, heading); a section read several times stands once."""
    return in_order(first_sections(sections).select("rfc_number", "section", "heading", "ordinal", "id")).select("rfc_number", "position", "section", "heading")


def children(sections: DataFrame) -> DataFrame:
    """(rfc_number, parent, section, heading): immediate children of every section, by string prefix."""
    parent = F.regexp_extract("section", r"^(.+)\.[^.]+$", 1)
    kids = first_sections(sections).select("rfc_number", parent.alias("parent"), "section", "heading").where("parent != ''")
    return kids.join(sections.select("rfc_number", F.col("section").alias("parent")).distinct(), ["rfc_number", "parent"], "left_semi")


def by_heading(sections: DataFrame) -> DataFrame:
    """The first section of each heading of a document."""
    return latest(sections.where("heading is not null and trim(heading) != ''"), ["rfc_number", "heading"], F.col("ordinal").asc_nulls_last(), F.col("id").asc())


def type_references(sections: DataFrame) -> DataFrame:
    """(id, rfc_number, target_section, heading): headings of the same document that a text names as a word.

    Words are cut at white space and brackets, commas, stops, colons; they begin with a capital, have two
    characters or more, and hold only letters, digits and underscores.
    """
    words = F.array_distinct(F.filter(F.split("text", r"[ \n\r\t(){},.:;\[\]]+"), lambda w: w.rlike(r"^[A-Z][A-Za-z0-9_]+$")))
    named = sections.select("id", "rfc_number", F.col("heading").alias("own"), F.explode(words).alias("heading")).where("own is null or own != heading")
    targets = by_heading(sections).where(F.col("heading").rlike(r"^[A-Z][A-Za-z0-9_]+$")).select("rfc_number", "heading", F.col("section").alias("target_section"))
    return named.join(targets, ["rfc_number", "heading"]).select("id", "rfc_number", "target_section", "heading")


def metadata(docs: DataFrame, number: int) -> DataFrame:
    """L07."""
    return docs.where(F.col("rfc_number") == number)


def listing(docs: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of (rfc_number, title) by number; limit from 1 to 1000, offset not below 0."""
    return docs.select("rfc_number", "title").orderBy("rfc_number").offset(max(offset, 0)).limit(max(1, min(limit, 1000)))


def reading_order(sections: DataFrame) -> DataFrame:
    """L14 for every document: where each section's text begins if texts are joined by a blank line.

    Texts themselves aren't gathered, so a document of any size takes no memory.
    """
    placed = in_order(sections.select("id", "rfc_number", "section", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")))
    before = Window.partitionBy("rfc_number").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("begins_at", F.coalesce(F.sum(F.col("n_chars") + 2).over(before), F.lit(0)))


def full_text(sections: DataFrame, number: int) -> DataFrame:
    """The text of one document, sections in order joined by a blank line."""
    one = in_order(sections.where(F.col("rfc_number") == number)).select("rfc_number", F.struct("position", F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    return one.groupBy("rfc_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n\n").alias("text"))


def preview(sections: DataFrame, most: int = 20) -> DataFrame:
    """The first sections of each document with an excerpt of 500 characters."""
    return in_order(first_sections(sections)).where(F.col("position") <= most).select("rfc_number", "position", "section", "heading", F.left("text", F.lit(500)).alias("excerpt"))


def hits_by_section(hits: DataFrame) -> DataFrame:
    """(section_id, hits): the distinct keyword hits of a section by line, then keyword."""
    once = hits.select("section_id", "line_offset", "keyword").where("section_id is not null").distinct()
    return once.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("line_offset", "keyword"))).alias("hits"))


def errata_by_section(errata: DataFrame, statuses: tuple[str, ...] = ERRATA_STATUSES) -> DataFrame:
    """(evidence, errata): errata of the given statuses by ``document#section``; blank sections are dropped. Of an
    erratum that was sent again only the current row counts."""
    kept = current_errata(errata).withColumn("section", F.trim("section")).where(F.col("status").isin(*statuses) & (F.col("section") != ""))
    return kept.groupBy(evidence_id("rfc_number", "section").alias("evidence")).agg(F.array_sort(F.collect_list(F.struct("errata_id", "status", "corrected_text"))).alias("errata"))
