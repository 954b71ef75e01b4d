"""Evaluation aggregates (M01-M20). ``ranking``: query_id, rank, item; ``expected``: query_id, item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_ranking(results: DataFrame, item: str = "rfc_number") -> DataFrame:
    """Each question's items once, at their first rank, ranked anew."""
    first = results.groupBy("query_id", F.col(item).alias("item")).agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item")))


def expected_sections(questions: DataFrame) -> DataFrame:
    """(query_id, rfc_number, section): each question's documents times its sections."""
    return questions.select("query_id", F.explode("documents").alias("rfc_number"), "sections").select("query_id", "rfc_number", F.explode("sections").alias("section"))


def retrieval_metrics(ranking: DataFrame, expected: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, hit, reciprocal_rank, ndcg); nothing expected gives 0 everywhere.

    The ideal gain counts expected rows as given, repeated ones too.
    """
    once = expected.select("query_id", "item").distinct().withColumn("good", F.lit(1))
    judged = ranking.join(once, ["query_id", "item"]).groupBy("query_id").agg(
        F.max((F.col("rank") <= k).cast("int")).alias("hit"), (1.0 / F.min("rank")).alias("rr"), F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain")
    )
    sizes = expected.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return (
        questions.select("query_id")
        .join(sizes, "query_id", "left")
        .join(judged, "query_id", "left")
        .select("query_id", F.coalesce("hit", F.lit(0)).alias("hit"), F.round(F.coalesce("rr", F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.when(F.col("n") > 0, F.coalesce("gain", F.lit(0.0)) / ideal).otherwise(0.0), 6).alias("ndcg"))
    )


def retrieval_summary(metrics: DataFrame, latency: str | None = None) -> DataFrame:
    """One row of means; latency cut to whole milliseconds; zeros if there is no question."""
    took = F.coalesce(F.avg(latency), F.lit(0.0)).cast("long") if latency else F.lit(0).cast("long")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return metrics.agg(F.count("*").alias("questions"), mean("hit").alias("hit_rate"), mean("reciprocal_rank").alias("mrr"), mean("ndcg").alias("ndcg"), took.alias("latency_ms"))


def precision(cited: Column, must: Column) -> Column:
    """0 if nothing is cited, 1 if nothing must be, else the share of cited documents that must be."""
    return F.when(F.size(cited) == 0, 0.0).when(F.size(must) == 0, 1.0).otherwise(F.size(F.array_intersect(cited, must)) / F.greatest(F.size(cited), F.lit(1)))


def recall(cited: Column, must: Column) -> Column:
    """1 if nothing must be cited, 0 if nothing is, else the share of those that must be."""
    return F.when(F.size(must) == 0, 1.0).when(F.size(cited) == 0, 0.0).otherwise(F.size(F.array_intersect(cited, must)) / F.greatest(F.size(F.array_distinct(must)), F.lit(1)))


def f1(p: Column, r: Column) -> Column:
    """M09."""
    return F.when((p <= 0) | (r <= 0), 0.0).otherwise(F.try_divide(2 * p * r, p + r))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """M07-M15 for rows of answer_id, answer_type, no_answer, cited, must_cite, should_not_cite, obsolete (arrays of
    documents), quotes (array of strings), faithful (how many quotes stand in the evidence, null if unknown) and
    support_rate. Null arrays count as empty."""
    empty = F.expr("cast(array() as array<int>)")
    ready = answers.withColumns({c: F.array_sort(F.array_distinct(F.coalesce(c, empty))) for c in ("cited", "must_cite", "should_not_cite", "obsolete")}).withColumn("quotes", F.coalesce("quotes", F.expr("cast(array() as array<string>)")))
    p, r = precision(F.col("cited"), F.col("must_cite")), recall(F.col("cited"), F.col("must_cite"))
    filled = F.size(F.filter("quotes", lambda q: q.isNotNull() & (F.trim(q) != "")))
    return (
        ready.withColumn("precision", F.round(p, 6))
        .withColumn("recall", F.round(r, 6))
        .withColumn("f1", F.round(f1(p, r), 6))
        .withColumn("forbidden", F.array_intersect("cited", "should_not_cite"))
        .withColumn("hallucinated", F.size("forbidden") > 0)
        .withColumn("declined_correctly", F.when(F.col("answer_type") == "no_answer", F.col("no_answer")))
        .withColumn("faithfulness", F.round(F.coalesce(F.try_divide(F.coalesce("faithful", filled), F.size("quotes")), F.lit(0.0)), 6))
        .withColumn("obsolete_rate", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("cited", "obsolete")), F.size("cited")), F.lit(0.0)), 6))
        .withColumn("support_rate", F.coalesce("support_rate", F.lit(0.0)))
        .select("answer_id", "cited", "precision", "recall", "f1", "forbidden", "hallucinated", "declined_correctly", "faithfulness", "obsolete_rate", "support_rate")
    )


def answer_summary(metrics: DataFrame) -> DataFrame:
    """One row of means; the share of correct declines ignores answers it doesn't apply to."""
    mean = lambda c: F.round(F.avg(c), 6)
    return metrics.agg(
        F.count("*").alias("answers"),
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
        mean("f1").alias("f1"),
        mean(F.col("hallucinated").cast("double")).alias("hallucination_rate"),
        mean(F.col("declined_correctly").cast("double")).alias("no_answer_accuracy"),
        mean("faithfulness").alias("faithfulness"),
        mean("obsolete_rate").alias("obsolete_rate"),
        mean("support_rate").alias("support_rate"),
    )


def benchmark(ranking: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """Share of questions with any expected item in their ranking, 4 places; one row."""
    hit = ranking.join(expected.distinct(), ["query_id", "item"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return questions.select("query_id").join(hit, "query_id", "left").agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 4).alias("hit_rate"))
