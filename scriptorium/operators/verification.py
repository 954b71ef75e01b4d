"""Citations and claims (A04-A11). ``answers``: answer_id, answer; ``citations``: answer_id, place, evidence, quote;
``evidence``: evidence, text. A claim is ``supported``, ``unsupported`` or ``uncited``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that don't end a sentence.
ABBREVIATIONS = ("e.g", "i.e", "etc", "al", "vs", "dr", "mr", "mrs", "ms", "st", "dept", "approx")
SPLITTER = r"(?<!\b(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r"))[.!?]\s+(?=[A-Z\"'(])"
MARKER = r"\[(\d+#[\d.]+)\]"
ANSWER_SCHEMA = "answer string, citations array<struct<evidenceId:string,relevantText:string>>"


def parse_responses(responses: DataFrame) -> DataFrame:
    """(answer_id, answer, place, evidence, quote) of JSON responses; malformed ones give a null answer."""
    parsed = responses.withColumn("x", F.from_json("response", ANSWER_SCHEMA))
    return parsed.select("answer_id", F.col("x.answer").alias("answer"), F.posexplode_outer("x.citations").alias("place", "c")).select("answer_id", "answer", "place", F.col("c.evidenceId").alias("evidence"), F.col("c.relevantText").alias("quote"))


def grounded(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations of known evidence with a quote that isn't blank and stands in it word for word."""
    return citations.where("quote is not null and trim(quote) != ''").join(evidence.select("evidence", F.col("text").alias("_text")), "evidence").where(F.contains("_text", "quote")).drop("_text")


def demoted(answers: DataFrame, kept: DataFrame, no_answer: str = "The available evidence is insufficient.") -> DataFrame:
    """Answers without a surviving citation become the fixed no-answer."""
    alive = kept.select("answer_id").distinct().withColumn("_alive", F.lit(True))
    return answers.join(alive, "answer_id", "left").withColumn("no_answer", F.col("_alive").isNull()).withColumn("answer", F.when(F.col("_alive").isNull(), F.lit(no_answer)).otherwise(F.col("answer"))).drop("_alive")


def claims(answers: DataFrame, pattern: str = SPLITTER) -> DataFrame:
    """(answer_id, claim_no, claim, markers); blank claims are dropped before numbering stays as split."""
    parts = answers.select("answer_id", F.posexplode(F.split("answer", pattern)).alias("claim_no", "claim")).withColumn("claim", F.trim("claim")).where("claim != ''")
    return parts.withColumn("markers", F.regexp_extract_all("claim", F.lit(MARKER), F.lit(1)))


def claim_status(answers: DataFrame, citations: DataFrame, evidence: DataFrame, pattern: str = SPLITTER) -> DataFrame:
    """A10: claims with their status; of several citations of one evidence the first counts."""
    split = claims(answers, pattern)
    first = citations.groupBy("answer_id", "evidence").agg(F.min_by("quote", "place").alias("quote"))
    holds = first.where("quote is not null and trim(quote) != ''").join(evidence.select("evidence", "text"), "evidence").where(F.contains("text", F.regexp_replace("quote", r"[.!? \t]+$", ""))).select("answer_id", "evidence")
    met = split.select("answer_id", "claim_no", F.explode("markers").alias("evidence")).join(holds, ["answer_id", "evidence"], "left_semi").select("answer_id", "claim_no").distinct().withColumn("_met", F.lit(True))
    status = F.when(F.size("markers") == 0, "uncited").when(F.col("_met"), "supported").otherwise("unsupported")
    return split.join(met, ["answer_id", "claim_no"], "left").withColumn("status", status).drop("_met")


def support_rate(statuses: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, claims, support_rate); 0 for an answer without claims."""
    rates = statuses.groupBy("answer_id").agg(F.count("*").alias("claims"), F.avg((F.col("status") == "supported").cast("double")).alias("rate"))
    return answers.select("answer_id").distinct().join(rates, "answer_id", "left").select("answer_id", F.coalesce("claims", F.lit(0)).alias("claims"), F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("support_rate"))


def errata_warnings(pack: DataFrame, citations: DataFrame) -> DataFrame:
    """Errata of a pack's rows that the answer cites."""
    cited = citations.select(F.col("answer_id").alias("query_id"), "evidence").distinct()
    return pack.where("errata is not null").join(cited, ["query_id", "evidence"], "left_semi").select("query_id", "evidence", F.explode("errata").alias("x")).select("query_id", "evidence", "x.errata_id", "x.corrected_text")
