"""Table maintenance: current rows, upserts, deletes, incremental comparison, counts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import normalized_status


def latest(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order; rows with a null key are kept as one key."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")


def current_documents(docs: DataFrame) -> DataFrame:
    """Of the readings of a document the one with the latest ``indexed_at_utc``."""
    return latest(docs.where("rfc_number is not null"), "rfc_number", F.col("indexed_at_utc").desc_nulls_last())


def first_sections(sections: DataFrame) -> DataFrame:
    """Of the rows with the same document and section the first by ordinal, then id."""
    return latest(sections, ["rfc_number", "section"], F.col("ordinal").asc_nulls_last(), F.col("id").asc())


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; ``new`` has one row a key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(df: DataFrame, gone: DataFrame, key: str = "rfc_number") -> DataFrame:
    """Rows of documents that aren't in ``gone``; rows with a null key stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def current_errata(errata: DataFrame) -> DataFrame:
    """One row for each erratum: of those sent again the latest reported, then the greatest status."""
    named = errata.where("errata_id is not null").withColumn("status", normalized_status("status"))
    return latest(named, "errata_id", F.col("reported_date").desc_nulls_last(), F.col("status").desc_nulls_last(), F.col("section").asc_nulls_last(), F.col("original_text").asc_nulls_last())


def changed(incoming: DataFrame, stored: DataFrame, force: bool = False, key: str = "rfc_number", digest: str = "source_sha256") -> DataFrame:
    """Incoming rows whose digest differs from the stored one; all of them if forced."""
    old = stored.select(key, F.col(digest).alias("_old"))
    return incoming.join(old, key, "left").where(F.lit(force) | ~F.col(digest).eqNullSafe(F.col("_old"))).drop("_old")


def latest_manifest(manifest: DataFrame, mirror_path: str | None = None) -> DataFrame:
    """The last run, of one mirror if given."""
    runs = manifest if mirror_path is None else manifest.where(F.col("mirror_path") == mirror_path)
    return runs.orderBy(F.col("created_at").desc_nulls_last(), F.col("id")).limit(1)


def latest_manifests(manifest: DataFrame) -> DataFrame:
    """S23 for every mirror at once."""
    return latest(manifest, "mirror_path", F.col("created_at").desc_nulls_last(), F.col("id").asc())


def corpus_stats(docs: DataFrame, sections: DataFrame, blocks: DataFrame, hits: DataFrame, errata: DataFrame, manifest: DataFrame) -> DataFrame:
    """Counts of the five tables, the last indexing time, and the latest manifest as JSON; one row."""
    run = latest_manifest(manifest).select(F.to_json(F.struct("mirror_path", "parser_type", "parser_version", "embedding_model", "embedding_dimensions")).alias("manifest"))
    counts = [
        current_documents(docs).agg(F.count("*").alias("documents"), F.max("indexed_at_utc").alias("last_indexed")),
        sections.agg(F.count("*").alias("sections")),
        blocks.agg(F.count("*").alias("grammar_blocks")),
        hits.agg(F.count("*").alias("keyword_hits")),
        current_errata(errata).agg(F.count("*").alias("errata")),
    ]
    row = counts[0]
    for more in [*counts[1:], run]:
        row = row.join(more, F.lit(True), "left")  # each side has one row
    return row
