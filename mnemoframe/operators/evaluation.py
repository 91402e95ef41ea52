"""Retrieval quality: hits, reciprocal ranks, leaks, differences between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_results(cases: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """``id, passed, rank, matched``: the best rank at which one of the expected keys is among the first k hits.

    ``cases`` has ``id, expected array``, ``hits`` ``id, key, rank``. A case without hits fails.
    """
    truth = cases.select("id", F.explode("expected").alias("key")).distinct()
    kind = hits.schema["key"].dataType
    met = hits.where(F.col("rank") <= k).join(truth.select("id", F.col("key").cast(kind).alias("key")), ["id", "key"])
    best = met.groupBy("id").agg(F.min("rank").alias("rank"), F.min_by("key", "rank").alias("matched"))
    return cases.select("id").join(best, "id", "left").select("id", F.col("rank").isNotNull().alias("passed"), "rank", "matched")


def run_summary(results: DataFrame) -> DataFrame:
    """``total, passed, failed, pass_rate, mrr`` in one row; no cases give zeros."""
    row = results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)).alias("_s"))
    return row.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)).alias("pass_rate"), F.coalesce(F.try_divide("_s", "total"), F.lit(0.0)).alias("mrr"))


def run_difference(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``id, change, rank_before, rank_now`` of cases in both runs that regressed, newly pass, or moved."""
    both = current.select("id", F.col("passed").alias("p"), F.col("rank").alias("rank_now")).join(baseline.select("id", F.col("passed").alias("b"), F.col("rank").alias("rank_before")), "id")
    change = F.when(F.col("b") & ~F.col("p"), "regression").when(~F.col("b") & F.col("p"), "new pass").when(F.col("rank_now") != F.col("rank_before"), "rank drift")
    return both.select("id", change.alias("change"), "rank_before", "rank_now").where("change IS NOT NULL")


def false_injects(distractors: DataFrame, hits: DataFrame, least: float, k: int = 3) -> DataFrame:
    """``distractors, leaks, rate``: prompts without a true answer for which one of the first k hits clears the bar."""
    leaking = hits.where((F.col("rank") <= k) & (F.round("cosine", 10) >= least)).select("id").distinct()
    marked = distractors.select("id").distinct().join(leaking.withColumn("leak", F.lit(1)), "id", "left")
    row = marked.agg(F.count("*").alias("distractors"), F.coalesce(F.sum("leak"), F.lit(0)).cast("long").alias("leaks"))
    return row.withColumn("rate", F.coalesce(F.try_divide("leaks", "distractors"), F.lit(0.0)))
