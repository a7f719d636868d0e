"""Reciprocal-rank fusion, late materialisation and hybrid search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Search
from .dense import dense_topk
from .lexical import Postings, plain_terms
from .scoring import topk


def fuse(lists: dict[str, DataFrame], key: str = "chunk_id", constant: int = 60, k: int = 10, decimals: int = 12) -> DataFrame:
    """Rank lists (query_id, key, rank, score) by name -> query_id, key, rrf_score, fused_rank and each list's rank and score.

    One union and one aggregation stand for the full outer joins of the lists. The sum
    runs over the named ranks in a fixed order, so it doesn't depend on shuffles.
    """
    rows = reduce(DataFrame.unionByName, (df.select("query_id", key, F.lit(name).alias("list"), "rank", "score") for name, df in lists.items()))
    own = lambda name, c: F.max(F.when(F.col("list") == name, F.col(c))).alias(f"{name}_{c}")
    wide = rows.groupBy("query_id", key).agg(*(own(n, c) for n in lists for c in ("rank", "score")))
    total = reduce(lambda a, b: a + b, (F.coalesce(1 / (F.lit(constant) + F.col(f"{n}_rank")), F.lit(0.0)) for n in lists))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc(key))
    return wide.withColumn("rrf_score", F.round(total, decimals)).withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= k)


def materialised(ranks: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Full rows for ranked ids only: the few ids are the side that the join may broadcast, if they are few."""
    return chunks.join(ranks, key)


def hybrid(chunks: DataFrame | Postings, queries: DataFrame, config: Search | None = None, key: str = "chunk_id", vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, hypothetical: DataFrame | None = None, sources: tuple[str, ...] | None = None, decimals: int = 6, analyser: Callable[[Column], Column] = plain_terms) -> DataFrame:
    """``chunks`` (key, source_id, terms, or text that ``analyser`` cuts, or their postings), ``queries`` (query_id, terms), vectors on either side if there are any -> fused ranks.

    ``vectors`` (key, source_id, vector); ``hypothetical`` (query_id, vector) adds a third
    list whose rank isn't returned. Queries without a vector are ranked by words alone.
    """
    config = config or Search()
    lists = {"lexical": topk(chunks, queries, config.bm25_candidates, key, sources, decimals, analyser)}
    if vectors is not None:
        if sources:
            vectors = vectors.where(F.col("source_id").isin(*sources))
        if query_vectors is not None:
            lists["dense"] = dense_topk(vectors, query_vectors, config.dense_candidates, key, decimals)
        if hypothetical is not None:
            lists["hypothetical"] = dense_topk(vectors, hypothetical, config.dense_candidates, key, decimals)
    out = fuse(lists, key, config.rrf_constant, config.final_results)
    for c in ("dense_rank", "dense_score"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("int" if c.endswith("rank") else "double"))
    return out.drop("hypothetical_rank", "hypothetical_score")
