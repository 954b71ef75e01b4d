"""Update and obsolete relations between documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_INTS = "cast(array() as array<int>)"


def edges(docs: DataFrame) -> DataFrame:
    """(rfc_number, target, kind), each once; kind is ``updates`` or ``obsoletes``. Null targets and lists give none."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.expr(NO_INTS)).alias("targets")) for k in ("updates", "obsoletes")))
    return docs.select("rfc_number", F.explode(kinds).alias("x")).select("rfc_number", F.col("x.kind").alias("kind"), F.explode("x.targets").alias("target")).where("target is not null and rfc_number is not null").distinct()


def back_references(docs: DataFrame, target: int | None = None) -> DataFrame:
    """(target, rfc_number): documents whose lists name the target; of one target if given."""
    found = edges(docs).select("target", "rfc_number").distinct()
    return found if target is None else found.where(F.col("target") == target)


def relations(docs: DataFrame) -> DataFrame:
    """For every document its lists and the documents that name it, sorted; both directions hold both kinds.

    The reverse direction is one aggregation over the edges; a document that many others name has as long a list
    as the reference's answer has.
    """
    links = edges(docs)
    reverse = links.groupBy(F.col("target").alias("rfc_number")).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "updates", F.col("rfc_number")))).alias("updated_by"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "obsoletes", F.col("rfc_number")))).alias("obsoleted_by"),
    )
    tidy = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.expr(NO_INTS))))).alias(c)
    mine = docs.select("rfc_number", tidy("updates"), tidy("obsoletes"))
    empty = F.expr(NO_INTS)
    return mine.join(reverse, "rfc_number", "left").select("rfc_number", "updates", "obsoletes", F.coalesce("updated_by", empty).alias("updated_by"), F.coalesce("obsoleted_by", empty).alias("obsoleted_by"))


def status(obsoleted_by: str = "obsoleted_by", updated_by: str = "updated_by") -> Column:
    """Obsoleted before updated before current; null where there is no relations row."""
    return F.when(F.size(obsoleted_by) > 0, "obsoleted").when(F.size(updated_by) > 0, "updated").when(F.col(obsoleted_by).isNotNull(), "current")


def with_status(results: DataFrame, related: DataFrame) -> DataFrame:
    """Q14: results with category, obsoleted_by and updated_by; null where the document has no row."""
    return results.join(related.select("rfc_number", status().alias("category"), "obsoleted_by", "updated_by"), "rfc_number", "left")


def obsolete_documents(docs: DataFrame) -> DataFrame:
    """(rfc_number): every document that another one obsoletes."""
    return edges(docs).where("kind = 'obsoletes'").select(F.col("target").alias("rfc_number")).distinct()
