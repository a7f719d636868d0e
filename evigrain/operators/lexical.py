"""Inverted index and BM25 for whole batches of queries.

``terms`` may be any array column: plain words (native) or ``analyze.analyze``
(stemmed). Only postings of terms that some query asks for are made while ranking:
the join with the distinct query terms comes before the one shuffle by document
and term, and scores are summed map-side before they meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import squeeze

QUERY_ERROR = "invalid query"


def plain_terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def valid_query(c: Column) -> Column:
    """The query with white space collapsed; null if it is empty or over the length limit."""
    q = squeeze(c)
    return F.when((q != "") & (F.length(q) <= fixed.MAX_QUERY_CHARS), q)


def query_terms(c: Column, folded: Column | None = None) -> Column:
    """Words of a query without stop words (all of them if nothing is left), at most 30; repeats count. ``folded``: the case-folded query, by default lower case."""
    found = F.regexp_extract_all(F.lower(c) if folded is None else folded, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    stop = F.array(*map(F.lit, fixed.QUERY_STOPWORDS))
    kept = F.filter(found, lambda t: ~F.array_contains(stop, t))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(found), 1, fixed.MAX_QUERY_TERMS)


def postings(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (key, terms) -> key, term, tf."""
    return docs.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, n_terms, avgdl."""
    dl = F.size("terms").cast("long")
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(dl), F.lit(0)).alias("n_terms"), F.coalesce(F.avg(dl), F.lit(0.0)).alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(fixed.BM25_IDF_FLOOR)).otherwise(raw)


@dataclass(frozen=True)
class Postings:
    """``rows``: key, source_id, dl, term, tf; ``terms``: term, df, or None (counted when asked); ``stats``: one row n_docs, avgdl. Stored tables also have ``shelf``, a hash of the term below ``shelves``."""

    rows: DataFrame
    terms: DataFrame | None
    stats: DataFrame
    shelves: int = 0

    @classmethod
    def of(cls, docs: DataFrame, key: str = "chunk_id", wanted: DataFrame | None = None) -> "Postings":
        """From ``docs`` (key, source_id, terms); only those of the ``wanted`` terms, if there are any. A document's matched words meet in one task, which counts them as a stream."""
        words = docs.select(key, "source_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
        if wanted is not None:
            # Dealt by key: frequencies and scores are summed where the words lie, and counting documents reuses this exchange.
            words = words.join(wanted, "term", "left_semi").repartition(key)
        return cls(words.groupBy(key, "source_id", "dl", "term").agg(F.count("*").alias("tf")), None, corpus_stats(docs))


def bm25(docs: DataFrame | Postings, queries: DataFrame, key: str = "chunk_id", sources: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (key, source_id, terms) or their postings, ``queries`` (query_id, terms) -> query_id, key, score of every match.

    A source filter only restricts the matches: document frequencies and the mean
    length stay those of the whole corpus. Of stored postings only files that can
    hold a query's term are read.
    """
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("repeat"))
    wanted = asked.select("term").distinct()
    if isinstance(docs, Postings):
        on = ["term"]
        if docs.shelves:
            wanted, on = wanted.withColumn("shelf", F.pmod(F.xxhash64("term"), F.lit(docs.shelves)).cast("int")), ["shelf", "term"]
        tf = docs.rows.join(wanted, on, "left_semi")
        df = docs.terms.join(wanted, on, "left_semi") if docs.terms is not None else None
    else:
        docs = Postings.of(docs, key, wanted)
        tf, df = docs.rows, None
    stats = docs.stats.first()  # one row of numbers
    if df is None:
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
    k1, b = fixed.BM25_K1, fixed.BM25_B
    avg = F.lit(float(stats["avgdl"] or 1.0))
    part = F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / avg))
    weights = asked.join(df, "term").select("query_id", "term", (F.col("repeat") * idf(F.lit(stats["n_docs"]), F.col("df"))).alias("w"))
    matched = tf if not sources else tf.where(F.col("source_id").isin(*sources))
    return matched.join(weights, "term").groupBy("query_id", key).agg(F.sum(F.col("w") * part).alias("score"))


def ranked(scores: DataFrame, key: str, k: int, decimals: int | None = None) -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller key."""
    s = F.col("score") if decimals is None else F.round("score", decimals)
    scores = scores.withColumn("score", s)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
