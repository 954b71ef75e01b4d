"""Evidence packs and claim verification over the whole tables (E and A operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import evidence_id
from scriptorium.operators import evidence as E
from scriptorium.operators import verification as A
from scriptorium.operators.relations import obsolete_documents, relations
from scriptorium.operators.tables import current_errata, first_sections
from scriptorium.plans import evaluate
from scriptorium.plans import inputs as I
from scriptorium.plans.register import Register
from scriptorium.plans.sql import CUR, EDGES, ERRATA, FIRST, RELATIONS

register = Register()
QUERIES, SQL = register.queries, register.sql

# The results that packs are made from: every section is a result of the question of its document's last two digits,
# scored by its length, so each table row takes part.
RESULTS_SQL = "results as (select rfc_number % 100 as query_id, id, rfc_number, section, heading, text, round(ln(1 + coalesce(length(text), 0)), 6) as score from rfc_sections where section is not null and rfc_number is not null)"
DEDUP_SQL = f"{RESULTS_SQL}, deduped as (select * exclude (rn) from (select *, row_number() over (partition by query_id, rfc_number, section order by score desc, id) rn from results) where rn = 1)"
ANCESTORS_SQL = """prefixes as (select query_id, rfc_number, array_to_string(p[1:n], '.') as section, section as child, score as child_score
    from (select *, string_split(section, '.') p, unnest(range(1, len(string_split(section, '.')))) n from deduped)),
    collapsed as (select d.* from deduped d where not exists (select 1 from prefixes p where p.query_id = d.query_id and p.rfc_number = d.rfc_number and p.section = d.section))"""
CAP_SQL = "capped as (select * from (select *, row_number() over (partition by query_id, rfc_number order by score desc, section, id) place, greatest(count(*) over (partition by query_id, rfc_number) - 5, 0) omitted from collapsed) where place <= 5)"
BUDGET_SQL = """budgeted as (select *, max(used > 16000) over (partition by query_id) exceeded from (select * exclude (place), row_number() over w as place, coalesce(length(text), 0) n_chars,
    sum(coalesce(length(text), 0)) over (partition by query_id order by score desc, rfc_number, section, id rows unbounded preceding) used from capped window w as (partition by query_id order by score desc, rfc_number, section, id)))"""
PACK_SQL = f"{DEDUP_SQL}, {ANCESTORS_SQL}, {CAP_SQL}, {BUDGET_SQL}, pack as (select * from budgeted where place = 1 or used <= 16000)"


def results(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.sections(spark, folder).where("section is not null and rfc_number is not null")
    return rows.select((F.col("rfc_number") % 100).alias("query_id"), "id", "rfc_number", "section", "heading", "text", F.round(F.log1p(F.coalesce(F.length("text"), F.lit(0))), 6).alias("score"))


def pack(spark: SparkSession, folder: str) -> DataFrame:
    return E.budget(E.cap(E.collapse(E.dedup(results(spark, folder)))))


@register("e02_dedup", f"with {DEDUP_SQL} select query_id, rfc_number, section, id from deduped")
def e02(spark: SparkSession, folder: str) -> DataFrame:
    return E.dedup(results(spark, folder).drop("text", "heading")).select("query_id", "rfc_number", "section", "id")


@register("e03_collapse", f"with {DEDUP_SQL}, {ANCESTORS_SQL} select query_id, rfc_number, section, id from collapsed")
def e03(spark: SparkSession, folder: str) -> DataFrame:
    return E.collapse(E.dedup(results(spark, folder).drop("text", "heading"))).select("query_id", "rfc_number", "section", "id")


@register(
    "e04_overlap_warnings",
    f"""with {DEDUP_SQL}, {ANCESTORS_SQL}, below as (select p.* from prefixes p join collapsed c on c.query_id = p.query_id and c.rfc_number = p.rfc_number and c.section = p.child
        where exists (select 1 from deduped d where d.query_id = p.query_id and d.rfc_number = p.rfc_number and d.section = p.section))
    select query_id, rfc_number, section, child from (select *, row_number() over (partition by query_id, rfc_number, section order by child_score desc, child) rn from below) where rn = 1""",
)
def e04(spark: SparkSession, folder: str) -> DataFrame:
    return E.overlap_warnings(E.dedup(results(spark, folder).drop("text", "heading")))


@register("e05_cap", f"with {DEDUP_SQL}, {ANCESTORS_SQL}, {CAP_SQL} select query_id, rfc_number, section, id, omitted from capped")
def e05(spark: SparkSession, folder: str) -> DataFrame:
    return E.cap(E.collapse(E.dedup(results(spark, folder).drop("text", "heading")))).select("query_id", "rfc_number", "section", "id", "omitted")


@register("e08_budget", f"with {PACK_SQL} select query_id, id, place, n_chars, used::bigint as used, exceeded as budget_exceeded from pack")
def e08(spark: SparkSession, folder: str) -> DataFrame:
    return pack(spark, folder).select("query_id", "id", "place", "n_chars", "used", "budget_exceeded")


@register("e09_pack_totals", f"with {PACK_SQL} select query_id, count(*) as sections, sum(n_chars)::bigint as total_chars, (sum(n_chars) // 4)::bigint as estimated_tokens, bool_or(exceeded) as budget_exceeded from pack group by query_id")
def e09(spark: SparkSession, folder: str) -> DataFrame:
    return E.pack_totals(pack(spark, folder))


@register("e10_budget_warnings", f"with {PACK_SQL} select query_id, 'evidence cut at 16000 characters; ' || count(*) || ' sections kept' as warning from pack where exceeded group by query_id")
def e10(spark: SparkSession, folder: str) -> DataFrame:
    return E.budget_warnings(pack(spark, folder))


@register(
    "e07_parent_headings",
    f"""with {FIRST}, secs as (select distinct rfc_number, section from rfc_sections where section is not null and rfc_number is not null),
    pre as (select rfc_number, section, array_to_string(p[1:n], '.') prefix, n from (select *, string_split(section, '.') p, unnest(range(1, len(string_split(section, '.')))) n from secs))
    select pre.rfc_number, pre.section, string_agg(f.heading, ' > ' order by n) as parents from pre join first_sec f on f.rfc_number = pre.rfc_number and f.section = pre.prefix where f.heading is not null group by pre.rfc_number, pre.section""",
)
def e07(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.sections(spark, folder)
    wanted = rows.where("section is not null and rfc_number is not null").select("rfc_number", "section").distinct().withColumn("query_id", F.lit(0))
    return E.parent_headings(wanted, rows).where("size(parents) > 0").select("rfc_number", "section", F.array_join("parents", " > ").alias("parents"))


@register("e11_relation_notes", f"with {CUR}, {RELATIONS}, {RESULTS_SQL} select distinct r.query_id, r.rfc_number, 'RFC ' || r.rfc_number || ' is obsoleted by RFC ' || array_to_string(obsoleted_by, ', ') as note from results r join rel using (rfc_number) where len(obsoleted_by) > 0 and r.query_id % 2 = 0")
def e11(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with an odd id want obsolete documents."""
    rows = results(spark, folder).select("query_id", "rfc_number")
    planned = rows.select("query_id").distinct().withColumn("include_obsolete", F.col("query_id") % 2 == 1)
    return E.relation_notes(rows, relations(I.documents(spark, folder)), planned)


@register("e13_pack_with_errata", f"""with {PACK_SQL}, {ERRATA} select query_id, p.id, rfc_number || '#' || section as evidence,
    (select count(*) from (select distinct line_offset, keyword from normative_occurrences n where n.section_id = p.id))::int as hits,
    (select count(*) from errata e where e.rfc_number = p.rfc_number and trim(e.section) = p.section and e.status = 'verified')::int as errata from pack p""")
def e13(spark: SparkSession, folder: str) -> DataFrame:
    """The assembled pack with its keyword hits and verified errata."""
    rows = E.assemble(results(spark, folder), I.sections(spark, folder), I.hits(spark, folder), I.errata(spark, folder))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return rows.select("query_id", "id", "evidence", size("hits").alias("hits"), size("errata").alias("errata"))


# Answers for verification: each current erratum is an answer of three sentences. The first holds its original text, with
# marks that could end a sentence blanked, an abbreviation before a capital, and a citation of the section it names; the
# second cites nothing; the third, with another abbreviation, cites what isn't quoted. So the twins know the claims.
EVIDENCE_SQL = f"{FIRST}, evidence as (select rfc_number || '#' || section as evidence, text from first_sec where section is not null and text is not null)"
ERR_SQL = f"{ERRATA}, err as (select errata_id, rfc_number, trim(section) as section, rfc_number || '#' || trim(section) as cited, original_text, corrected_text from errata where section is not null and rfc_number is not null)"
NO_MARKS = "[.!?\"'()\\[\\]\\s]+"
HOLDS_SQL = "trim(original_text) <> '' and exists (select 1 from evidence v where v.evidence = cited and contains(v.text, original_text))"
HOLDS_CUT_SQL = "trim(original_text) <> '' and exists (select 1 from evidence v where v.evidence = cited and contains(v.text, regexp_replace(original_text, '[.!? \\t]+$', '')))"
CITABLE_SQL = "regexp_matches(cited, '^[0-9]+#[0-9.]+$')"


def evidence_rows(spark: SparkSession, folder: str) -> DataFrame:
    return first_sections(I.sections(spark, folder)).where("section is not null and text is not null").select(evidence_id("rfc_number", "section").alias("evidence"), "text")


def answer_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(answers, citations) of the current errata that name a section."""
    kept = current_errata(I.errata(spark, folder)).where("section is not null and rfc_number is not null").withColumn("section", F.trim("section"))
    cited = evidence_id("rfc_number", "section")
    bare = F.regexp_replace(F.coalesce("original_text", F.lit("")), NO_MARKS, " ")
    text = F.concat(F.lit("It says so, e.g. Here "), bare, F.lit(" ["), cited, F.lit("]. Nobody cites this! See approx. Numbers [9#9]"))
    answers = kept.select(F.col("errata_id").alias("answer_id"), text.alias("answer"))
    citations = kept.select(F.col("errata_id").alias("answer_id"), F.lit(0).alias("place"), cited.alias("evidence"), F.col("original_text").alias("quote"))
    return answers, citations


@register("a04_responses", f"with {EVIDENCE_SQL}, {ERR_SQL} select errata_id as answer_id, case when errata_id % 3 = 0 then null else 'Answer ' || errata_id end as answer, case when errata_id % 3 > 0 then cited end as evidence, case when errata_id % 3 > 0 then original_text end as quote, errata_id % 3 > 0 and coalesce({HOLDS_SQL}, false) as grounded from err")
def a04(spark: SparkSession, folder: str) -> DataFrame:
    """A reply in JSON for each current erratum, a third of them malformed, and whether its citation is grounded."""
    cited = answer_rows(spark, folder)[1]
    reply = F.to_json(F.struct(F.concat(F.lit("Answer "), "answer_id").alias("answer"), F.array(F.struct(F.col("evidence").alias("evidenceId"), F.col("quote").alias("relevantText"))).alias("citations")))
    parsed = A.parse_responses(cited.select("answer_id", F.when(F.col("answer_id") % 3 == 0, "{not json").otherwise(reply).alias("response")))
    kept = A.grounded(parsed.where("evidence is not null"), evidence_rows(spark, folder)).select("answer_id", F.lit(True).alias("grounded"))
    return parsed.join(kept, "answer_id", "left").select("answer_id", "answer", "evidence", "quote", F.coalesce("grounded", F.lit(False)).alias("grounded"))


@register("a05_grounded_citations", f"with {EVIDENCE_SQL}, {ERR_SQL} select errata_id as answer_id, cited as evidence from err where {HOLDS_SQL}")
def a05(spark: SparkSession, folder: str) -> DataFrame:
    return A.grounded(answer_rows(spark, folder)[1], evidence_rows(spark, folder)).select("answer_id", "evidence")


@register("a06_demoted", f"with {EVIDENCE_SQL}, {ERR_SQL} select errata_id as answer_id, not coalesce({HOLDS_SQL}, false) as no_answer from err")
def a06(spark: SparkSession, folder: str) -> DataFrame:
    answers, citations = answer_rows(spark, folder)
    return A.demoted(answers, A.grounded(citations, evidence_rows(spark, folder))).select("answer_id", "no_answer")


@register(
    "a07_errata_warnings",
    f"""with {PACK_SQL}, {ERRATA}, packed as (select distinct query_id, rfc_number || '#' || section as evidence, rfc_number, section from pack)
    select p.query_id, p.evidence, e.errata_id, e.corrected_text from packed p join errata e on e.rfc_number = p.rfc_number and trim(e.section) = p.section and e.status = 'verified' and trim(e.section) <> '' where p.rfc_number % 2 = 0""",
)
def a07(spark: SparkSession, folder: str) -> DataFrame:
    """Every pack's answer cites its sections of documents with an even number."""
    rows = E.assemble(results(spark, folder), I.sections(spark, folder), I.hits(spark, folder), I.errata(spark, folder))
    return A.errata_warnings(rows, rows.where("rfc_number % 2 = 0").select(F.col("query_id").alias("answer_id"), "evidence"))


BARE_SQL = f"regexp_replace(coalesce(original_text, ''), '{NO_MARKS.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
CLAIMS_SQL = f"""{EVIDENCE_SQL}, {ERR_SQL}, told as (select *, {CITABLE_SQL} as citable, {HOLDS_CUT_SQL} as holds from err),
    statuses as (select errata_id as answer_id, 0 as claim_no, 'It says so, e.g. Here ' || {BARE_SQL} || ' [' || cited || ']' as claim, citable::int as markers, case when not citable then 'uncited' when holds then 'supported' else 'unsupported' end as status from told
    union all select errata_id, 1, 'Nobody cites this', 0, 'uncited' from told union all select errata_id, 2, 'See approx. Numbers [9#9]', 1, 'unsupported' from told)"""


@register("a08_claims", f"with {CLAIMS_SQL} select answer_id, claim_no, claim, markers from statuses")
def a08(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of the answers by the full splitter, with their number of citations."""
    return A.claims(answer_rows(spark, folder)[0]).select("answer_id", "claim_no", "claim", F.size("markers").alias("markers"))


@register("a10_claim_status", f"with {CLAIMS_SQL} select answer_id, claim_no, status from statuses")
def a10(spark: SparkSession, folder: str) -> DataFrame:
    answers, citations = answer_rows(spark, folder)
    return A.claim_status(answers, citations, evidence_rows(spark, folder)).select("answer_id", "claim_no", "status")


@register("a11_support_rate", f"with {CLAIMS_SQL} select answer_id, count(*) as claims, round(avg((status = 'supported')::int), 6) as support_rate from statuses group by answer_id")
def a11(spark: SparkSession, folder: str) -> DataFrame:
    answers, citations = answer_rows(spark, folder)
    return A.support_rate(A.claim_status(answers, citations, evidence_rows(spark, folder)), answers)


@register(
    "m19_answer_evaluation",
    f"""with {CLAIMS_SQL}, {CUR}, {EDGES}, kept as (select errata_id, rfc_number from err where {HOLDS_SQL}), old as (select distinct target from edges where kind = 'obsoletes'),
    judged as (select e.errata_id, e.rfc_number, k.errata_id is not null as held, e.errata_id % 2 = 0 as right_document, coalesce(s.rate, 0) as rate from err e left join kept k using (errata_id)
        left join (select answer_id, avg((status = 'supported')::int) rate from statuses group by answer_id) s on s.answer_id = e.errata_id)
    select errata_id as answer_id, case when held and right_document then 1e0 else 0e0 end as "precision", case when held and right_document then 1e0 else 0e0 end as recall, held and errata_id % 5 = 0 as hallucinated,
        case when errata_id % 7 = 0 then not held end as declined_correctly, case when held then 1e0 else 0e0 end as faithfulness, case when held and rfc_number in (select target from old) then 1e0 else 0e0 end as obsolete_rate, round(rate, 6) as support_rate from judged""",
)
def m19(spark: SparkSession, folder: str) -> DataFrame:
    """The answers judged against a question set in which every other one must cite the document it names."""
    answers, citations = answer_rows(spark, folder)
    kept = A.grounded(citations, evidence_rows(spark, folder))
    support = A.support_rate(A.claim_status(answers, citations, evidence_rows(spark, folder)), answers)
    number = F.split("evidence", "#")[0].cast("int")
    asked = citations.select(F.col("answer_id").alias("query_id"), F.when(F.col("answer_id") % 7 == 0, "no_answer").otherwise("factual").alias("answer_type"), F.array(F.when(F.col("answer_id") % 2 == 0, number).otherwise(F.lit(-1))).alias("must_cite"), F.array(F.when(F.col("answer_id") % 5 == 0, number).otherwise(F.lit(-2))).alias("should_not_cite"))
    judged = evaluate.answers(A.demoted(answers, kept), kept, support, asked, obsolete_documents(I.documents(spark, folder)))
    return judged.select("answer_id", "precision", "recall", "hallucinated", "declined_correctly", "faithfulness", "obsolete_rate", "support_rate")
