"""An index run from mirror files to published tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import Options
from scriptorium.operators import embedding as E
from scriptorium.operators import parsing as P
from scriptorium.operators import tables as T
from scriptorium.operators.retrieval import postings
from scriptorium.sources.files import discover, with_xml
from scriptorium.sources.json_files import read_errata
from scriptorium.sources.store import Store
from scriptorium.session import default_parallelism, stage_table

PARSER_VERSION = "1"


def parse_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, sections) of text files; ids are digests of document and ordinal, so a rerun gives the same."""
    headed = stage_table(P.with_header(files))
    bodies = headed.select("rfc_number", P.without_contents(P.without_pages("body")).alias("body"))
    sections = P.split_sections(bodies, "rfc_number").join(headed.select("rfc_number", "title", "source_path", "source_sha256"), "rfc_number")
    documents = headed.select("rfc_number", "source_path", "source_sha256", "title", "updates", "obsoletes", "rfc_date", "category", "authors", "issn")
    return documents, sections


def parse_xml(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = stage_table(with_xml(files))
    known = files.select("rfc_number", "source_path", "source_sha256")
    none = F.expr("cast(array() as array<int>)")
    documents = parsed.join(known, "rfc_number").select("rfc_number", "source_path", "source_sha256", "title", none.alias("updates"), none.alias("obsoletes"), "rfc_date", "category", "authors", F.lit(None).cast("string").alias("issn"))
    rows = parsed.select("rfc_number", "title", F.posexplode("sections").alias("ordinal", "s"))
    return documents, rows.select("rfc_number", (F.col("ordinal") + 1).alias("ordinal"), "s.section", "s.heading", "s.text", "title").join(known, "rfc_number")


def index_run(spark: SparkSession, options: Options, provider: E.Provider | None = None, force: bool = False, only: int | None = None) -> dict:
    """Index what changed, publish a snapshot and a manifest row; returns the counts.

    ``only`` indexes one document and fails if it isn't in the mirror. A change of the embedding length forces a
    full run, since old vectors can't be searched with new ones.
    """
    options.validate()
    if provider is None and options.embedding_model != "none":
        raise ValueError("no embedding provider; set embedding_model to none to index for lexical search alone")
    store = Store(spark, options.store_path)
    last = store.manifest().orderBy(F.col("created_at").desc()).first()
    if last and last["embedding_dimensions"] not in (None, options.embedding_dimensions):
        force = True
    files = discover(spark, options.mirror_path, options.parser)
    if only is not None:
        files = files.where(F.col("rfc_number") == only)
        if files.isEmpty():
            raise LookupError(f"document {only} is not in the mirror")
    stored = store.table("indexed_rfcs")
    fresh = stage_table(T.changed(files, stored, force))
    new: dict[str, DataFrame] = {}
    gone: dict[str, DataFrame] = {}
    counted = E.counters(spark)
    if not fresh.isEmpty():
        gone["rfc_number"] = fresh.select("rfc_number")
        spread = fresh.repartition(max(options.indexing_parallelism, default_parallelism(spark)), "rfc_number")
        text_docs, text_sections = parse_text(spread.where("not is_xml").drop("is_xml"))
        xml_docs, xml_sections = parse_xml(spread.where("is_xml").drop("is_xml"))
        documents, sections = text_docs.unionByName(xml_docs), text_sections.unionByName(xml_sections)
        sections = sections.withColumn("id", F.sha2(F.concat_ws("#", "rfc_number", "ordinal"), 256)).withColumn("url", F.concat(F.lit("rfc:"), F.col("rfc_number")))
        if provider is None:
            sections = sections.withColumn("embedding", F.lit(None).cast("array<float>"))
        else:
            sections = stage_table(sections)
            vectors = E.embed(sections, provider, options.embedding_dimensions, batch=options.embedding_batch_size, concurrency=options.embedding_concurrency, counted=counted)
            sections = sections.join(vectors, "id")
        sections = stage_table(sections)
        blocks = P.grammar_blocks(sections).withColumn("id", F.sha2(F.concat_ws("#", "section_id", "block_no"), 256))
        hits = P.keyword_hits(sections).withColumn("id", F.sha2(F.concat_ws("#", "section_id", "line_offset", "keyword"), 256))
        counts = sections.groupBy("rfc_number").agg(F.count("*").alias("section_count"))
        documents = documents.join(counts, "rfc_number", "left").join(P.grammar_styles(sections).select("rfc_number", "grammar_style"), "rfc_number", "left").withColumn("section_count", F.coalesce("section_count", F.lit(0))).withColumn("grammar_style", F.coalesce("grammar_style", F.lit("none"))).withColumn("indexed_at_utc", F.current_timestamp())
        new |= {"rfc_sections": sections, "normative_occurrences": hits, "rfc_abnf_blocks": blocks, "indexed_rfcs": documents, "postings": stage_table(postings(sections))}
    if options.errata_path:
        known = store.table("rfc_errata")
        read = T.current_errata(read_errata(spark, options.errata_path))
        changed = stage_table(read.join(known, (read["errata_id"] == known["errata_id"]) & reduce(lambda a, b: a & b, (read[c].eqNullSafe(known[c]) for c in read.columns)), "left_anti"))
        if not changed.isEmpty():
            new["rfc_errata"], gone["errata_id"] = changed, changed.select("errata_id")
    layout = store.write(new, gone) if new else store.layout()
    documents, sections = (store.table(name, layout).count() for name in ("indexed_rfcs", "rfc_sections"))
    model = {"embedding_provider": "none" if provider is None else "injected", "embedding_model": options.embedding_model}
    store.publish(layout, mirror_path=options.mirror_path, parser_type=options.parser, parser_version=PARSER_VERSION, **model, embedding_dimensions=options.embedding_dimensions, embedding_batch_size=options.embedding_batch_size, rfc_count=documents, section_count=sections)
    return {"indexed": fresh.count(), "documents": documents, "sections": sections, **{f"embedding_{name}": counter.value for name, counter in counted.items()}}


def reset_embeddings(spark: SparkSession, options: Options, provider: E.Provider) -> dict:
    """Every document is indexed again, changed or not."""
    return index_run(spark, options, provider, force=True)

