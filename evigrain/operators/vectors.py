"""Embedding by an injected batch provider, with a cache keyed by model, size, chunk and source hash."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("model", "dimensions", "chunk_id", "source_sha256")

Provider = Callable[[list[str]], list[list[float]]]


class EmbeddingError(RuntimeError):
    """The provider failed, or gave vectors of another number or size."""


def cache_misses(chunks: DataFrame, cache: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Chunks without a cached vector for exactly this model, size, id and source hash."""
    valid = cache.where((F.col("model") == model) & (F.col("dimensions") == dimensions)).select("chunk_id", "source_sha256")
    return chunks.join(valid, ["chunk_id", "source_sha256"], "left_anti")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both, the fresh row where both have the key."""
    both = cache.withColumn("_age", F.lit(1)).unionByName(fresh.withColumn("_age", F.lit(0)))
    order = Window.partitionBy(*KEY).orderBy("_age")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_age")


def document_text(title: str, text: str) -> str:
    return f"Title: {title}\n\n{text}"


def with_retry(call: Callable[[], list[list[float]]], attempts: int = 3, most_seconds: float = 30.0, retry_after: Callable[[Exception], float | None] = lambda e: None, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """At most ``attempts`` calls; waits what the error asks for (60 s at most), else 1, 2, 4 ... seconds with jitter."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if i + 1 == attempts:
                raise EmbeddingError(str(e)) from e
            asked = retry_after(e)
            sleep(min(60.0, asked) if asked is not None else min(most_seconds, 2.0**i + random.random()))
    raise EmbeddingError("no attempt was made")


def embed_chunks(chunks: DataFrame, provider: Provider, model: str, dimensions: int, batch: int = 16, attempts: int = 3, interval: float = 0.0) -> DataFrame:
    """``chunks`` (chunk_id, source_sha256, title, text) -> cache rows; each task calls the provider in batches, paced by ``interval`` seconds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                texts = [document_text(t, x) for t, x in zip(part["title"], part["text"], strict=True)]
                if any(not (x or "").strip() for x in part["text"]):
                    raise EmbeddingError("a blank text can't be embedded")
                time.sleep(max(0.0, last + interval - time.monotonic()))
                last = time.monotonic()
                got = with_retry(lambda texts=texts: provider(texts), attempts)
                if len(got) != len(part) or any(len(v) != dimensions for v in got):
                    raise EmbeddingError("the provider gave vectors of another number or size")
                yield pd.DataFrame({"model": model, "dimensions": dimensions, "chunk_id": part["chunk_id"].values, "source_sha256": part["source_sha256"].values, "vector": [list(map(float, v)) for v in got]})

    return chunks.select("chunk_id", "source_sha256", "title", "text").mapInPandas(run, "model string, dimensions int, chunk_id string, source_sha256 string, vector array<float>")


def embed_queries(queries: DataFrame, provider: Provider) -> DataFrame:
    """``queries`` (query_id, query) -> query_id, vector; a batch that fails has null vectors, so its queries fall back to words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            try:
                got = provider(list(f["query"]))
            except Exception:
                got = [None] * len(f)
            yield pd.DataFrame({"query_id": f["query_id"].values, "vector": got})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query").mapInPandas(run, f"query_id {kind}, vector array<float>")


def build_report(chunks: DataFrame, cache: DataFrame, model: str, dimensions: int) -> DataFrame:
    """One row: chunk_count, embedded_chunk_count, cache_misses, mode (``hybrid`` if every chunk has a vector)."""
    valid = cache.where((F.col("model") == model) & (F.col("dimensions") == dimensions)).select("chunk_id", "source_sha256", F.lit(True).alias("_hit")).distinct()
    out = chunks.join(valid, ["chunk_id", "source_sha256"], "left").agg(F.count("*").alias("chunk_count"), F.count("_hit").alias("embedded_chunk_count"), F.count_if(F.col("_hit").isNull()).alias("cache_misses"))
    return out.withColumn("mode", F.when((F.col("chunk_count") > 0) & (F.col("cache_misses") == 0), "hybrid").otherwise("lexical"))
