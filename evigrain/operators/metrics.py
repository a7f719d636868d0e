"""Retrieval and classifier metrics as aggregates over labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_scores(cases: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """``cases`` (query_id, expected_source_id, relevant_pages), ``results`` (query_id, source_id, pages, rank) -> query_id, first_hit, reciprocal_rank, coverage."""
    top = results.where(F.col("rank") <= k).select("query_id", F.col("source_id").alias("_source"), F.col("pages").alias("_pages"), F.col("rank").alias("_rank"))
    joined = cases.join(top, "query_id", "left")
    own = F.col("_source") == F.col("expected_source_id")
    hit = own & F.arrays_overlap("_pages", "relevant_pages")
    per = joined.groupBy("query_id").agg(
        F.min(F.when(hit, F.col("_rank"))).alias("first_hit"),
        F.first("relevant_pages").alias("_gold"),
        F.array_distinct(F.flatten(F.collect_list(F.when(own, F.col("_pages"))))).alias("_found"),
    )
    gold = F.array_distinct("_gold")
    return per.select("query_id", "first_hit", F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"), (F.size(F.array_intersect(gold, "_found")) / F.size(gold)).alias("coverage"))


def retrieval_metrics(scores: DataFrame) -> DataFrame:
    """One row: cases, hit_rate, mrr, coverage."""
    return scores.agg(F.count("*").alias("cases"), F.avg(F.col("first_hit").isNotNull().cast("double")).alias("hit_rate"), F.avg("reciprocal_rank").alias("mrr"), F.avg("coverage").alias("coverage"))


def acceptance(cases: DataFrame, threshold: float, null_passes: bool) -> DataFrame:
    """``cases`` (top_score) -> accepted, total. A missing score passes in the retrieval run and fails in the gate run."""
    ok = F.coalesce(F.col("top_score") >= F.lit(threshold), F.lit(null_passes))
    return cases.agg(F.count_if(ok).alias("accepted"), F.count("*").alias("total"))


def accuracy(cases: DataFrame, expected: str, actual: str, minimum: float) -> DataFrame:
    """One row: cases, correct, accuracy, passed."""
    same = F.col(expected).eqNullSafe(F.col(actual))
    out = cases.agg(F.count("*").alias("cases"), F.count_if(same).alias("correct"), F.avg(same.cast("double")).alias("accuracy"))
    return out.withColumn("passed", F.coalesce(F.col("accuracy") >= F.lit(minimum), F.lit(False)))
