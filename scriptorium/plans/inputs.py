"""Tables of a data folder, and the question set that the registered queries ask."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.vectors import is_usable
from scriptorium.operators.retrieval import stored_postings
from scriptorium.operators.tables import current_documents, latest
from scriptorium.session import stage_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rfc_sections")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Current rows only."""
    return current_documents(table(spark, folder, "indexed_rfcs"))


def hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "normative_occurrences")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rfc_abnf_blocks")


def errata(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rfc_errata")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "index_manifest")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return sections(spark, folder).where(is_usable("embedding")).select("id", "rfc_number", "section", F.col("embedding").alias("vector"))


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """The stored inverted table of a folder's sections: written to the shared folder when first asked for and read from
    then on, by this application and for these files only."""
    context = spark.sparkContext
    rows = sections(spark, folder)
    files = sorted(rows.inputFiles())
    conf = context._jsc.hadoopConfiguration()

    def stamp(file: str) -> str:
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        found = path.getFileSystem(conf).getFileStatus(path)
        return f"{file} {found.getLen()} {found.getModificationTime()}"

    name = hashlib.sha256("\n".join(map(stamp, files)).encode()).hexdigest()
    at = f"{stage_folder(spark)}/postings-{name}"
    done = context._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        stored_postings(rows).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query, vector): the title of each current document whose number is divisible by 20, with the
    embedding of its first section that has a usable one. Every question meets all rows."""
    asked = documents(spark, folder).where("rfc_number % 20 = 0 and trim(title) != ''").select(F.col("rfc_number").alias("query_id"), F.col("title").alias("query"))
    first = latest(sections(spark, folder).where("rfc_number % 20 = 0").where(is_usable("embedding")).select("rfc_number", "ordinal", "id", "embedding"), "rfc_number", F.col("ordinal").asc_nulls_last(), F.col("id").asc())
    return asked.join(first.select(F.col("rfc_number").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")
