"""Reranking by an injected scorer, corrective merge, pruning and the confidence gate.

A scorer is a function of two string columns that gives a logit column: a pandas UDF
around a model, or a native expression. Its result should be stored before two
branches read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sigmoid

Scorer = Callable[[Column, Column], Column]


def rerank(results: DataFrame, scorer: Scorer, candidates: int, key: str = "chunk_id") -> DataFrame:
    """``results`` (query_id, query, key, text, rrf_score, fused_rank) -> the first ``candidates`` with rerank_score and rerank_rank; the rest goes."""
    few = results.where(F.col("fused_rank") <= candidates).withColumn("rerank_score", sigmoid(scorer(F.col("query"), F.col("text"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("rrf_score"), F.asc(key))
    return few.withColumn("rerank_rank", F.row_number().over(order))


def rescored(results: DataFrame, scorer: Scorer) -> DataFrame:
    """All candidates scored, none dropped (a second pass must not lose its wider pool)."""
    return results.withColumn("rerank_score", sigmoid(scorer(F.col("query"), F.col("text"))))


def weak_queries(query_ids: DataFrame, results: DataFrame, threshold: float) -> DataFrame:
    """Queries whose best score is missing or below ``threshold``: query_id, top_score."""
    top = results.groupBy("query_id").agg(F.max("rerank_score").alias("top_score"))
    return query_ids.select("query_id").join(top, "query_id", "left").where(F.col("top_score").isNull() | (F.col("top_score") < F.lit(threshold)))


def merged(initial: DataFrame, corrected: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """Both passes, the corrected row where both have one, best k by (score, key)."""
    both = initial.withColumn("pass", F.lit(1)).unionByName(corrected.withColumn("pass", F.lit(2)), allowMissingColumns=True)
    latest = Window.partitionBy("query_id", key).orderBy(F.desc("pass"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), F.asc(key))
    one = both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    return one.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= k)


def valid_score(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & c.between(0, 1)


def gated(query_ids: DataFrame, results: DataFrame, least: float, prune: bool) -> DataFrame:
    """One row a query: status, top_confidence, removed_chunks.

    A query with a score that isn't in 0..1 has status ``unavailable``; without results, or
    with a best score below ``least``, ``insufficient_evidence``. ``prune``: results below
    ``least`` don't count, and are counted as removed.
    """
    score = F.col("rerank_score")
    per = results.groupBy("query_id").agg(
        F.max(score).alias("top"),
        F.bool_or(~valid_score(score)).alias("bad"),
        F.count_if(score < F.lit(least)).alias("below"),
    )
    out = query_ids.select("query_id").join(per, "query_id", "left")
    bad = F.coalesce("bad", F.lit(False))
    passed = F.coalesce(F.col("top") >= F.lit(least), F.lit(False))
    status = F.when(bad, "unavailable").when(passed, "evidence_retrieved").otherwise("insufficient_evidence")
    removed = F.when(bad, F.lit(0)).otherwise(F.coalesce("below", F.lit(0))) if prune else F.lit(0)
    return out.select("query_id", status.alias("status"), F.when(~bad, F.col("top")).alias("top_confidence"), removed.cast("long").alias("removed_chunks"))
