"""Sources and table maintenance over the whole tables (S, C operators)."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import blank_to_null, document_number, normalized_status
from scriptorium.operators import tables as T
from scriptorium.plans import inputs as I
from scriptorium.plans.register import Register
from scriptorium.plans.sql import CUR, status
from scriptorium.session import stage_folder
from scriptorium.sources.json_files import read_errata, read_questions
from scriptorium.sources.store import Store

register = Register()
QUERIES, SQL = register.queries, register.sql


@register("s02_file_numbers", "select rfc_number, source_path, try_cast(nullif(regexp_extract(source_path, '(?i)(?:^|/)rfc([0-9]{1,9})\\.(?:txt|xml)$', 1), '') as int) as file_number from indexed_rfcs")
def s02(spark: SparkSession, folder: str) -> DataFrame:
    return I.table(spark, folder, "indexed_rfcs").select("rfc_number", "source_path", document_number("source_path").alias("file_number"))


@register("s04_content_hash", "select id, upper(sha256(text)) as digest from rfc_sections where text is not null")
def s04(spark: SparkSession, folder: str) -> DataFrame:
    return I.sections(spark, folder).where("text is not null").select("id", F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


@register("s08_errata_fields", "select errata_id, nullif(trim(section), '') as section, nullif(trim(original_text), '') as original_text, nullif(trim(corrected_text), '') as corrected_text, year(reported_date) as reported_year from rfc_errata where errata_id > 0")
def s08(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.errata(spark, folder).where("errata_id > 0")
    return rows.select("errata_id", *(blank_to_null(c).alias(c) for c in ("section", "original_text", "corrected_text")), F.year("reported_date").alias("reported_year"))


@register("s09_status", f"select errata_id, {status('status')} as status from rfc_errata")
def s09(spark: SparkSession, folder: str) -> DataFrame:
    return I.errata(spark, folder).select("errata_id", normalized_status("status").alias("status"))


@register("s11_section_scan", "select id, rfc_number, section, ordinal, heading from rfc_sections")
def s11(spark: SparkSession, folder: str) -> DataFrame:
    return I.sections(spark, folder).select("id", "rfc_number", "section", "ordinal", "heading")


@register("s12_excerpt", "select id, left(text, 500) as excerpt, length(text) as n_chars from rfc_sections")
def s12(spark: SparkSession, folder: str) -> DataFrame:
    return I.sections(spark, folder).select("id", F.left("text", F.lit(500)).alias("excerpt"), F.length("text").alias("n_chars"))


@register("s16_delete_documents", f"with {CUR} select s.id, s.rfc_number from rfc_sections s where not exists (select 1 from cur c, (select distinct unnest(obsoletes) n from cur) o where o.n = s.rfc_number and c.rfc_number = o.n)")
def s16(spark: SparkSession, folder: str) -> DataFrame:
    """Sections left after every indexed document that another one obsoletes is deleted."""
    docs = I.documents(spark, folder)
    gone = docs.select(F.explode("obsoletes").alias("rfc_number")).join(docs.select("rfc_number"), "rfc_number", "left_semi")
    return T.delete_documents(I.sections(spark, folder).select("id", "rfc_number"), gone)


@register("s17_upsert_documents", f"with {CUR} select rfc_number, source_sha256, section_count from cur")
def s17(spark: SparkSession, folder: str) -> DataFrame:
    """Readings up to 2024 upserted with the current row of each document."""
    readings = I.table(spark, folder, "indexed_rfcs").select("rfc_number", "source_sha256", "section_count", "indexed_at_utc")
    old = T.current_documents(readings.where("indexed_at_utc < timestamp '2025-01-01'"))
    return T.upsert(old, T.current_documents(readings), "rfc_number").select("rfc_number", "source_sha256", "section_count")


@register("s18_upsert_errata", f"select errata_id, rfc_number, status, reported_date from (select errata_id, rfc_number, {status('status')} as status, reported_date, row_number() over (partition by errata_id order by reported_date desc nulls last, {status('status')} desc nulls last, section nulls last, original_text nulls last) rn from rfc_errata where errata_id is not null) where rn = 1")
def s18(spark: SparkSession, folder: str) -> DataFrame:
    return T.current_errata(I.errata(spark, folder)).select("errata_id", "rfc_number", "status", "reported_date")


@register("s20_changed_documents", f"with {CUR}, inc as (select rfc_number, max(source_sha256) source_sha256 from rfc_sections group by rfc_number) select inc.rfc_number, inc.source_sha256 from inc left join cur using (rfc_number) where inc.source_sha256 is distinct from cur.source_sha256")
def s20(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose sections carry another digest than the current row."""
    incoming = I.sections(spark, folder).groupBy("rfc_number").agg(F.max("source_sha256").alias("source_sha256"))
    return T.changed(incoming, I.documents(spark, folder))


@register("s21_counts", "select (select count(*) from indexed_rfcs) as readings, (select count(distinct rfc_number) from indexed_rfcs) as documents, (select count(*) from rfc_sections) as sections")
def s21(spark: SparkSession, folder: str) -> DataFrame:
    docs = I.table(spark, folder, "indexed_rfcs").agg(F.count("*").alias("readings"), F.countDistinct("rfc_number").alias("documents"))
    return docs.join(I.sections(spark, folder).agg(F.count("*").alias("sections")), F.lit(True))


@register("s22_manifest_append", "select mirror_path, count(*) as runs, max(rfc_count) as most from (select mirror_path, rfc_count from index_manifest union all select distinct mirror_path, 0 from index_manifest) group by mirror_path")
def s22(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of each mirror in a store after its past runs were published and one more without changes for each."""
    store = Store(spark, f"{stage_folder(spark)}/store-{uuid.uuid4().hex}")
    runs = I.manifest(spark, folder)
    store.publish_runs(runs)
    store.publish_runs(runs.select("mirror_path").distinct().select(*(F.col(c) if c == "mirror_path" else F.lit(0 if c == "rfc_count" else None).cast(k).alias(c) for c, k in runs.dtypes)))
    return store.manifest().groupBy("mirror_path").agg(F.count("*").alias("runs"), F.max("rfc_count").alias("most"))


@register("s07_errata_json", f"select errata_id, rfc_number, nullif(trim(section), '') as section, coalesce(nullif({status('status')}, ''), 'reported') as status, reported_date from rfc_errata where errata_id > 0 and rfc_number > 0")
def s07(spark: SparkSession, folder: str) -> DataFrame:
    """Every erratum written to a JSON snapshot under other field names, and read again."""
    rows = I.errata(spark, folder).select(F.col("errata_id").cast("string").alias("EID"), F.concat(F.lit("RFC"), F.col("rfc_number")).alias("doc-id"), "section", F.col("status").alias("errata_status_code"), F.col("reported_date").cast("string").alias("submit_date"))
    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False, encoding="utf-8") as file:
        json.dump({"Entries": [*(json.loads(r) for r in rows.toJSON().toLocalIterator()), {"EID": "x"}, 3]}, file)
    try:
        return read_errata(spark, file.name).select("errata_id", "rfc_number", "section", "status", "reported_date")
    finally:
        os.unlink(file.name)


@register("s10_question_sets", f"with {CUR} select rfc_number::varchar as query_id, title as query, array_to_string(list_transform(list_filter(coalesce(obsoletes, []), lambda x: x is not null), lambda x: x::varchar), ',') as documents, case when rfc_number % 2 = 0 then 'testdata' else 'full' end as corpus from cur where title is not null and rfc_number % 2 = 0")
def s10(spark: SparkSession, folder: str) -> DataFrame:
    """A question for every current document written to a JSON file under mixed names, and one of its two corpora read again."""
    rows = I.documents(spark, folder).where("title is not null").select(
        F.col("rfc_number").cast("string").alias("ID"), F.col("title").alias("Question"), F.array_compact(F.coalesce("obsoletes", F.expr("cast(array() as array<int>)"))).alias("expectedRfcs"), F.when(F.col("rfc_number") % 2 == 0, "testdata").otherwise("full").alias("Corpus")
    )
    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False, encoding="utf-8") as file:
        json.dump([json.loads(r) for r in rows.toJSON().toLocalIterator()], file)
    try:
        found = read_questions(spark, file.name, "testdata")
    finally:
        os.unlink(file.name)
    return found.select("query_id", "query", F.array_join(F.transform("documents", lambda x: x.cast("string")), ",").alias("documents"), "corpus")


@register("s23_latest_manifest", "select mirror_path, id, created_at, rfc_count from (select *, row_number() over (partition by mirror_path order by created_at desc nulls last, id) rn from index_manifest) where rn = 1")
def s23(spark: SparkSession, folder: str) -> DataFrame:
    return T.latest_manifests(I.manifest(spark, folder)).select("mirror_path", "id", "created_at", "rfc_count")


@register(
    "l13_corpus_stats",
    f"""with {CUR}, m as (select * from index_manifest order by created_at desc nulls last, id limit 1)
    select (select count(*) from cur) as documents, (select max(indexed_at_utc) from cur) as last_indexed, (select count(*) from rfc_sections) as sections,
    (select count(*) from rfc_abnf_blocks) as grammar_blocks, (select count(*) from normative_occurrences) as keyword_hits,
    (select count(distinct errata_id) from rfc_errata) as errata, m.embedding_model, m.embedding_dimensions from m""",
)
def l13(spark: SparkSession, folder: str) -> DataFrame:
    row = T.corpus_stats(I.table(spark, folder, "indexed_rfcs"), I.sections(spark, folder), I.blocks(spark, folder), I.hits(spark, folder), I.errata(spark, folder), I.manifest(spark, folder))
    return row.withColumn("embedding_model", F.get_json_object("manifest", "$.embedding_model")).withColumn("embedding_dimensions", F.get_json_object("manifest", "$.embedding_dimensions").cast("int")).drop("manifest")


@register("c07_dimension_check", "select id, embedding_dimensions, len(embedding) as found from rfc_sections cross join (select embedding_dimensions from index_manifest order by created_at desc nulls last, id limit 1) where embedding is not null and len(embedding) <> embedding_dimensions")
def c07(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose vector doesn't have the length of the last run's manifest."""
    run = T.latest_manifest(I.manifest(spark, folder)).select("embedding_dimensions")
    rows = I.sections(spark, folder).where("embedding is not null").select("id", F.size("embedding").alias("found"))
    return rows.join(F.broadcast(run), F.col("found") != F.col("embedding_dimensions")).select("id", "embedding_dimensions", "found")  # one row
