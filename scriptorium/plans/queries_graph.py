"""Lookup, navigation and hierarchies over the whole tables (L operators and p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import hierarchy as H
from scriptorium.operators import navigation as L
from scriptorium.operators import relations as R
from scriptorium.operators.tables import first_sections
from scriptorium.plans import inputs as I
from scriptorium.plans.register import Register
from scriptorium.plans.sql import CUR, EDGES, ERRATA, FIRST, PATH, RELATIONS, STATUS
from scriptorium.schema import ERRATA_STATUSES

register = Register()
QUERIES, SQL = register.queries, register.sql

ORDERED = f"row_number() over (partition by rfc_number order by {PATH} nulls last, section nulls last, id)"


@register("l01_get_section", f"with {FIRST} select rfc_number, section, id from first_sec")
def l01(spark: SparkSession, folder: str) -> DataFrame:
    return first_sections(I.sections(spark, folder)).select("rfc_number", "section", "id")


@register("l02_section_order", f"select rfc_number, section, id, {ORDERED} as position from rfc_sections")
def l02(spark: SparkSession, folder: str) -> DataFrame:
    return L.in_order(I.sections(spark, folder).select("rfc_number", "section", "id"))


@register("l03_contents", f"with {FIRST} select rfc_number, {ORDERED} as position, section, heading from first_sec")
def l03(spark: SparkSession, folder: str) -> DataFrame:
    return L.table_of_contents(I.sections(spark, folder))


@register(
    "l04_children",
    f"""with {FIRST}, kids as (select rfc_number, regexp_extract(section, '^(.+)\\.[^.]+$', 1) as parent, section, heading from first_sec)
    select k.* from kids k where parent <> '' and exists (select 1 from rfc_sections s where s.rfc_number = k.rfc_number and s.section = k.parent)""",
)
def l04(spark: SparkSession, folder: str) -> DataFrame:
    return L.children(I.sections(spark, folder)).select("rfc_number", "parent", "section", "heading")


@register("l05_by_heading", "select rfc_number, heading, section, id from (select *, row_number() over (partition by rfc_number, heading order by ordinal nulls last, id) rn from rfc_sections where trim(heading) <> '') where rn = 1")
def l05(spark: SparkSession, folder: str) -> DataFrame:
    return L.by_heading(I.sections(spark, folder)).select("rfc_number", "heading", "section", "id")


@register(
    "l06_type_references",
    """with words as (select id, rfc_number, heading own, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[ \\n\\r\\t(){},.:;\\[\\]]+'), lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9_]+$')))) heading from rfc_sections),
    targets as (select rfc_number, heading, section target_section from (select *, row_number() over (partition by rfc_number, heading order by ordinal nulls last, id) rn from rfc_sections where trim(heading) <> '') where rn = 1)
    select w.id, w.rfc_number, t.target_section, w.heading from words w join targets t using (rfc_number, heading) where own is null or own <> w.heading""",
)
def l06(spark: SparkSession, folder: str) -> DataFrame:
    return L.type_references(I.sections(spark, folder))


@register("l07_metadata", f"with {CUR} select rfc_number, title, category, rfc_date, issn, grammar_style, len(authors) as authors from cur")
def l07(spark: SparkSession, folder: str) -> DataFrame:
    return I.documents(spark, folder).select("rfc_number", "title", "category", "rfc_date", "issn", "grammar_style", F.when(F.col("authors").isNotNull(), F.size("authors")).alias("authors"))


@register("l08_listing", f"with {CUR} select rfc_number, title from cur order by rfc_number limit 100 offset 20")
def l08(spark: SparkSession, folder: str) -> DataFrame:
    return L.listing(I.documents(spark, folder), 100, 20)


@register("l09_back_references", f"with {CUR}, {EDGES} select distinct target, rfc_number from edges")
def l09(spark: SparkSession, folder: str) -> DataFrame:
    return R.back_references(I.documents(spark, folder))


def listed(column: str) -> str:
    return f"array_to_string({column}, ',') as {column}"


@register("l10_relations", f"with {CUR}, {RELATIONS} select rfc_number, {listed('updates')}, {listed('obsoletes')}, {listed('updated_by')}, {listed('obsoleted_by')} from rel")
def l10(spark: SparkSession, folder: str) -> DataFrame:
    related = R.relations(I.documents(spark, folder))
    return related.select("rfc_number", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("updates", "obsoletes", "updated_by", "obsoleted_by")))


@register("l11_status", f"with {CUR}, {RELATIONS} select rfc_number, {STATUS} as category from rel")
def l11(spark: SparkSession, folder: str) -> DataFrame:
    return R.relations(I.documents(spark, folder)).select("rfc_number", R.status().alias("category"))


@register("l12_relation_report", f"with {CUR}, {EDGES} select target as rfc_number, kind || '_by' as kind, count(*) as n, min(rfc_number) as first, max(rfc_number) as last from edges group by target, kind")
def l12(spark: SparkSession, folder: str) -> DataFrame:
    links = R.edges(I.documents(spark, folder))
    return links.groupBy(F.col("target").alias("rfc_number"), F.concat("kind", F.lit("_by")).alias("kind")).agg(F.count("*").alias("n"), F.min(links["rfc_number"]).alias("first"), F.max(links["rfc_number"]).alias("last"))


@register(
    "l14_reading_order",
    f"""with p as (select id, rfc_number, section, coalesce(length(text), 0) n_chars, {ORDERED} as position from rfc_sections)
    select id, rfc_number, position, n_chars, coalesce(sum(n_chars + 2) over (partition by rfc_number order by position rows between unbounded preceding and 1 preceding), 0)::bigint as begins_at from p""",
)
def l14(spark: SparkSession, folder: str) -> DataFrame:
    return L.reading_order(I.sections(spark, folder)).select("id", "rfc_number", "position", "n_chars", "begins_at")


@register("l15_preview", f"with {FIRST} select rfc_number, position, section, excerpt from (select rfc_number, {ORDERED} as position, section, left(text, 500) as excerpt from first_sec) where position <= 20")
def l15(spark: SparkSession, folder: str) -> DataFrame:
    return L.preview(I.sections(spark, folder)).select("rfc_number", "position", "section", "excerpt")


@register("l16_section_hits", "select section_id, string_agg(line_offset || ':' || keyword, ',' order by line_offset, keyword) as hits from (select distinct section_id, line_offset, keyword from normative_occurrences where section_id is not null) group by section_id")
def l16(spark: SparkSession, folder: str) -> DataFrame:
    grouped = L.hits_by_section(I.hits(spark, folder))
    return grouped.select("section_id", F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["line_offset"], x["keyword"])), ",").alias("hits"))


@register(
    "l17_errata_by_section",
    f"with {ERRATA} select rfc_number || '#' || trim(section) as evidence, count(*) as n, min(errata_id) as first from errata where status in ({', '.join(repr(s) for s in ERRATA_STATUSES)}) and trim(section) <> '' group by 1",
)
def l17(spark: SparkSession, folder: str) -> DataFrame:
    return L.errata_by_section(I.errata(spark, folder)).select("evidence", F.size("errata").cast("long").alias("n"), F.col("errata")[0]["errata_id"].alias("first"))


LINKS = f"""{CUR}, links as (select distinct rfc_number src, t dst from (select rfc_number, unnest(list_concat(coalesce(updates, []), coalesce(obsoletes, []))) t from cur)
    where t in (select rfc_number from cur)),
    reach as (select src, dst, 1 as depth from links union select r.src, l.dst, r.depth + 1 from reach r join links l on l.src = r.dst where r.depth < 120)"""


@register(
    "p3_found",
    f"""with recursive {LINKS} select src as rfc_number, dst as root_number, min(depth) as depth from reach where dst not in (select src from links) group by src, dst
    union all select distinct src, -1, -1 from reach where src = dst""",
)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return H.roots_and_depths(I.documents(spark, folder))


@register(
    "p3_paths",
    f"""with recursive {LINKS}, best as (select src, dst as root, min(depth) as depth from reach where dst not in (select src from links) group by src, dst),
    hop as (select b.src, b.root, b.depth, min(l.dst) as nxt from best b join links l on l.src = b.src left join best c on c.src = l.dst and c.root = b.root
        where (l.dst = b.root and b.depth = 1) or c.depth = b.depth - 1 group by b.src, b.root, b.depth),
    walk as (select src, root, depth, src as at, 0 as step, src::varchar as path from best
        union all select w.src, w.root, w.depth, h.nxt, w.step + 1, w.path || ',' || h.nxt from walk w join hop h on h.src = w.at and h.root = w.root)
    select src as rfc_number, root as root_number, depth, path from walk where step = depth""",
)
def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """A shortest path to each root, its numbers joined by commas."""
    found = H.paths(I.documents(spark, folder))
    return found.withColumn("path", F.array_join(F.transform("path", lambda n: n.cast("string")), ","))


@register("p3_descendants", f"with recursive {LINKS} select dst as rfc_number, src as descendant, min(depth) as depth from reach group by src, dst")
def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All documents that build on each document."""
    return H.descendants(I.documents(spark, folder))
