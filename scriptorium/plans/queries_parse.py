"""Parsing over the whole tables (P and U operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import embedding as E
from scriptorium.operators import parsing as P
from scriptorium.plans import inputs as I
from scriptorium.plans.register import Register
from scriptorium.plans.sql import CUR, KEYWORD
from scriptorium.sources.files import with_xml

register = Register()
QUERIES, SQL = register.queries, register.sql

PLAIN = "replace(text, chr(13) || chr(10), chr(10))"


def line_rows(*keep: str, source: str = "rfc_sections", text: str = PLAIN) -> str:
    columns = ", ".join(keep)
    return f"lines as (select {columns}, unnest(l) as line, unnest(range(len(l))) as pos from (select {columns}, string_split({text}, chr(10)) l from {source}))"


# Each section's text with page lines of its document put before, into and after it, and lines that only look like some.
PAGED = "'RFC ' || rfc_number || ' Notes 2020' || chr(10) || text || chr(10) || '   [Page ' || ordinal || ']' || chr(10) || chr(12) || ' RFC ' || rfc_number || '   Notes' || chr(10) || 'see RFC ' || rfc_number || ' [Page 1]' || chr(10) || 'RFC none'"
UNPAGED = "chr(10) || text || chr(10) || chr(10) || chr(10) || 'see RFC ' || rfc_number || ' [Page 1]' || chr(10) || 'RFC none'"


def without_page_lines(text: str) -> str:
    return f"regexp_replace(regexp_replace(replace({text}, chr(13) || chr(10), chr(10)), '{P.PAGE_HEADER}', '', 'g'), '{P.PAGE_FOOTER}', '', 'g')"


@register(
    "p07_p08_page_lines",
    f"select id, length(t) as n_chars, md5(t) as digest, t <> replace(paged, chr(13) || chr(10), chr(10)) as changed from (select id, {PAGED} as paged, {without_page_lines(PAGED)} as t from rfc_sections where text is not null and rfc_number is not null and ordinal is not null)",
)
def p07(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.sections(spark, folder).where("text is not null and rfc_number is not null and ordinal is not null").select("id", F.expr(PAGED.replace("chr(", "char(")).alias("paged"))
    bare = rows.select("id", P.without_pages("paged").alias("t"), F.replace("paged", F.lit("\r\n"), F.lit("\n")).alias("plain"))
    return bare.select("id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"), (F.col("t") != F.col("plain")).alias("changed"))


@register(
    "p11_split_sections",
    f"""with {line_rows('id', source="(select id, section || '. ' || text as body from rfc_sections where section is not null and text is not null)", text="replace(body, chr(13) || chr(10), chr(10))")},
    marked as (select id, pos, line, regexp_matches(line, '{P.HEADING}') h from lines),
    numbered as (select *, sum(h::int) over (partition by id order by pos) ordinal from marked),
    grouped as (select id, ordinal::int as ordinal, max(case when h then regexp_extract(line, '{P.HEADING}', 1) end) as section, max(case when h then regexp_extract(line, '{P.HEADING}', 2) end) as heading,
        regexp_replace(regexp_replace(string_agg(case when h then regexp_extract(line, '{P.HEADING}', 2) else line end, chr(10) order by pos), '\\A[ \\t\\n\\v\\f\\r]+', ''), '[ \\t\\n\\v\\f\\r]+\\z', '') as text
        from numbered where ordinal > 0 group by id, ordinal)
    select id, ordinal, section, heading, length(text) as n_chars from grouped where text <> ''""",
)
def p11(spark: SparkSession, folder: str) -> DataFrame:
    """Each section's text behind its number, split again at headings."""
    bodies = I.sections(spark, folder).where("section is not null and text is not null").select("id", F.concat("section", F.lit(". "), "text").alias("body"))
    return P.split_sections(bodies, "id").select("id", "ordinal", "section", "heading", F.length("text").alias("n_chars"))


@register(
    "p12_grammar_blocks",
    f"""with {line_rows('id', 'rfc_number', source="(select * from rfc_sections where regexp_matches(text, '(?m)" + P.RULE + "'))")},
    marked as (select *, regexp_matches(line, '{P.RULE}') r, not regexp_matches(line, '{P.RULE}') and (trim(line) = '' or not regexp_matches(line, '^\\s')) b from lines),
    run as (select *, sum(r::int) over w as block_no, max(case when r then pos end) over w as begun, max(case when b then pos else -1 end) over w as broke from marked window w as (partition by id order by pos))
    select id as section_id, rfc_number, block_no::int as block_no, string_agg(line, chr(10) order by pos) as abnf_text from run where block_no > 0 and broke < begun group by id, rfc_number, block_no""",
)
def p12(spark: SparkSession, folder: str) -> DataFrame:
    return P.grammar_blocks(I.sections(spark, folder)).select("section_id", "rfc_number", "block_no", "abnf_text")


@register("p13_rule_names", f"select id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as names from (select id, regexp_extract_all(abnf_text, '(?m){P.RULE}', 1) l from rfc_abnf_blocks where abnf_text is not null)")
def p13(spark: SparkSession, folder: str) -> DataFrame:
    return I.blocks(spark, folder).where("abnf_text is not null").select("id", F.array_join(P.rule_names("abnf_text"), ",").alias("names"))


@register("p14_keyword_hits", f"with {line_rows('id', 'rfc_number')} select id as section_id, rfc_number, unnest(regexp_extract_all(line, '{KEYWORD}', 1)) as keyword, pos::int as line_offset from lines")
def p14(spark: SparkSession, folder: str) -> DataFrame:
    return P.keyword_hits(I.sections(spark, folder))


@register(
    "p15_grammar_styles",
    f"""with {line_rows('rfc_number')}, flagged as (select rfc_number, regexp_matches(line, '{P.STYLE_PATTERNS['cddl']}') c, regexp_matches(line, '{P.RULE}') a,
        regexp_matches(line, '{P.STYLE_PATTERNS['tls-presentation-lang']}') t, regexp_matches(line, '{P.STYLE_PATTERNS['asn.1']}') s from lines),
    counted as (select rfc_number, sum((not c and a)::int)::bigint abnf, sum((not c and t)::int)::bigint tls, sum(c::int)::bigint cddl, sum((not c and s)::int)::bigint asn1 from flagged group by rfc_number)
    select *, case when abnf + tls + cddl + asn1 = 0 then 'none' when abnf > (abnf + tls + cddl + asn1) // 2 then 'abnf' when tls > (abnf + tls + cddl + asn1) // 2 then 'tls-presentation-lang'
        when cddl > (abnf + tls + cddl + asn1) // 2 then 'cddl' when asn1 > (abnf + tls + cddl + asn1) // 2 then 'asn.1'
        when abnf = greatest(abnf, tls, cddl, asn1) then 'abnf' when tls = greatest(abnf, tls, cddl, asn1) then 'tls-presentation-lang' when cddl = greatest(abnf, tls, cddl, asn1) then 'cddl' else 'asn.1' end as grammar_style
    from counted""",
)
def p15(spark: SparkSession, folder: str) -> DataFrame:
    return P.grammar_styles(I.sections(spark, folder))


@register(
    "u07_vocabulary_vectors",
    "with held as (select id, list_filter([" + ", ".join(f"case when contains(upper(coalesce(text, '')), '{w}') then {at} end" for w, at in E.VOCABULARY.items()) + "], lambda x: x is not null) as spots from rfc_sections) "
    "select id, array_to_string(list_transform(list_sort(spots), lambda x: x::varchar), ',') as dimensions, case when len(spots) > 0 then round(1 / sqrt(len(spots)), 6) else 0e0 end as weight from held",
)
def u07(spark: SparkSession, folder: str) -> DataFrame:
    """Dimensions of each text's vector that aren't zero, and what they hold."""
    vectors = I.sections(spark, folder).select("id", E.vocabulary_vector("text").alias("v"))
    at = F.filter(F.transform("v", lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    return vectors.select("id", F.array_join(F.transform(at, lambda x: x.cast("string")), ",").alias("dimensions"), F.round(F.array_max("v"), 6).alias("weight"))


HELD_SQL = SQL["u07_vocabulary_vectors"]


@register("u01_embed", HELD_SQL)
def u01(spark: SparkSession, folder: str) -> DataFrame:
    """The same vectors through batches of a provider."""
    vectors = E.embed(I.sections(spark, folder), E.vocabulary_provider(), E.WIDTH)
    spots = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    return vectors.select("id", F.array_join(F.transform(spots, lambda x: x.cast("string")), ",").alias("dimensions"), F.round(F.array_max("embedding").cast("double"), 6).alias("weight"))


XML_FILE = """concat('<rfc xmlns="u" category="c', rfc_number % 5, '"><front><title>T  ', rfc_number, '</title><author fullname="A. B', rfc_number, '"/><author surname="C"/><date year="', rfc_number, '"/></front><middle><section><name>One</name><t>first ',
    rfc_number, '</t><section title="Sub"><t>a</t><t> b\n c</t></section></section><section><name>Gap</name></section><section><name>Three</name><t>last</t></section></middle><back><section><t>no</t></section></back></rfc>')"""


@register(
    "s06_p16_p17_xml",
    f"""with {CUR} select rfc_number, 'T ' || rfc_number as title, rfc_number::varchar as rfc_date, 'c' || rfc_number % 5 as category, 'A. B' || rfc_number || '|C' as authors, section, heading, text from cur,
    (select unnest(['1', '1.1', '3']) as section, unnest(['One', 'Sub', 'Three']) as heading, unnest(['first ', 'a' || chr(10) || chr(10) || 'b c', 'last']) as part), lateral (select case when section = '1' then part || rfc_number else part end as text)
    where rfc_number % 7 > 0""",
)
def s06(spark: SparkSession, folder: str) -> DataFrame:
    """An XML file made for every current document; one in seven is malformed and gives nothing."""
    files = I.documents(spark, folder).select("rfc_number", F.when(F.col("rfc_number") % 7 == 0, "<rfc>").otherwise(F.expr(XML_FILE)).alias("text"))
    rows = with_xml(files).select("rfc_number", "title", "rfc_date", "category", F.array_join("authors", "|").alias("authors"), F.explode("sections").alias("s"))
    return rows.select("rfc_number", "title", "rfc_date", "category", "authors", "s.section", "s.heading", "s.text")


# A whole document made around every section: its header, front matter and contents are known, so the twin states what
# must come out instead of scanning for it.
FILE = """concat('Working Group                     A. Writer', char(13), char(10), 'Updates: ', rfc_number - 1, ', RFC ', rfc_number - 2, ', 0, x', char(10), 'Obsoletes: ', rfc_number - 3, ' Someone', char(10),
    'Category: Kind ', ordinal, '   ', char(10), 'ISSN: 2070-', rfc_number, char(10), 'Date: May ', ordinal, char(10), 'Authors: A. B', ordinal, ',  C. D', char(10), char(10), '          Notes on ', rfc_number, '   ', char(10),
    '          Part ', ordinal, char(10), char(10), 'Status of This Memo', char(10), char(10), '   This memo is a test.', char(10), char(10), 'Abstract', char(10), char(10), '   Words.', char(10), char(10),
    'Table of Contents', char(10), char(10), '   ', ordinal, '. Part', char(10), char(10), ordinal, '.  Part', char(10), 'first line', char(10), 'Category: Other', char(10), coalesce(text, ''))"""


@register(
    "p02_p10_headers",
    """select id, 'Notes on ' || rfc_number || '           Part ' || ordinal as title, 'Kind ' || ordinal as category, 'May ' || ordinal as rfc_date, '2070-' || rfc_number as issn,
    concat_ws(',', rfc_number - 1, rfc_number - 2) as updates, (rfc_number - 3)::varchar as obsoletes, 'A. B' || ordinal || '|C. D' as authors,
    md5('Abstract' || chr(10) || chr(10) || '   Words.' || chr(10) || chr(10) || ordinal || '.  Part' || chr(10) || 'first line' || chr(10) || 'Category: Other' || chr(10) || replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) as body
    from rfc_sections where rfc_number > 3 and ordinal is not null and not contains(coalesce(text, ''), chr(0))""",
)
def p02(spark: SparkSession, folder: str) -> DataFrame:
    """P02-P06, P09, P10 on a document made around every section."""
    files = I.sections(spark, folder).where("rfc_number > 3 and ordinal is not null and not contains(coalesce(text, ''), char(0))").select("id", "rfc_number", F.expr(FILE).alias("text"))
    body = F.md5(P.without_contents("body").cast("binary"))
    numbers = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",").alias(c)
    return P.with_header(files).select("id", "title", "category", "rfc_date", "issn", numbers("updates"), numbers("obsoletes"), F.array_join("authors", "|").alias("authors"), body.alias("body"))
