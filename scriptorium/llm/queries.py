"""The pN_ queries of this subpackage: each takes (spark, directory) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from scriptorium.llm.neighbours import nearest
from scriptorium.llm.packing import fill_containers
from scriptorium.llm.spans import shared_spans
from scriptorium.llm.splitting import oversized_units, split_oversized
from scriptorium.llm.tokenizer import encode_corpus, token_counts
from scriptorium.llm.truncation import truncated, truncation_by_source


def sections(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rfc_sections.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered pieces of at most 2,000 characters of every longer section."""
    return split_oversized(sections(spark, folder))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return oversized_units(sections(spark, folder))


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar rows of every usable row; wide routing to few, larger shards, since neighbours may be distant."""
    return nearest(sections(spark, folder), margin=0.3, ef=80, shard_rows=24_000)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Only neighbours of cosine 0.90 and more are wanted, so the operator routes narrowly."""
    near = nearest(sections(spark, folder), min_cosine=0.9, band=0.08)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Three-word shingles and a similarity of 0.6, as the problem's statement gives them."""
    return near_duplicate_pairs(sections(spark, folder), words=3, threshold=0.6)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(sections(spark, folder), words=3, threshold=0.6)


def p5_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Each row's shared spans, their characters and their share of the text."""
    table = sections(spark, folder)
    spans = shared_spans(table)
    sizes = table.select("id", F.length("text").alias("n_chars"))
    return spans.join(sizes, "id").withColumn("shared_share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(sections(spark, folder)).select("id", "shared_chars")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(documents(spark, folder))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of 2,048 ids; first is the id of the document at which the part begins."""
    return fill_containers(token_counts(documents(spark, folder)))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(documents(spark, folder)).select("doc_id").distinct()


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, cut documents and their share for each source."""
    return truncation_by_source(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_spans": p5_spans,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_sources": p8_sources,
}
