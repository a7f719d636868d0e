"""Integrity checks on a chunk corpus, as an array of error codes per chunk and a rollup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import fixed, text

#: Type of each required field, for a corpus that lacks the column.
_TYPES = {"page_start": "int", "page_end": "int", "estimated_tokens": "int", "pages": "array<int>", "sections": "array<string>", "safety_tags": "array<string>"}
REQUIRED = ("chunk_id", "source_id", "title", "source_url", "source_sha256", "page_start", "page_end", "pages", "sections", "text", "estimated_tokens", "safety_tags", "publisher")


class AuditError(RuntimeError):
    """The corpus may not be indexed."""


def _first_of_id(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``_first``: is it the first (by source, then ordinal) of its chunk_id? Of rows alike in all three, one is.

    Aggregations and a join of ids alone, so that an id with very many copies is no single window; only rows alike in
    id, source and ordinal are numbered.
    """
    alike = chunks.groupBy("chunk_id", "source_id", "chunk_ordinal").agg(F.count("*").alias("n"))
    least = alike.groupBy("chunk_id").agg(F.min(F.struct("source_id", "chunk_ordinal", "n")).alias("_least"))
    rows = chunks.join(least, "chunk_id", "left")
    mine = F.coalesce(F.struct("source_id", "chunk_ordinal") == F.struct("_least.source_id", "_least.chunk_ordinal"), F.lit(True))
    rows = rows.withColumns({"_first": mine, "_alike": F.coalesce(mine & (F.col("_least.n") > 1), F.lit(False))}).drop("_least")
    order = Window.partitionBy("chunk_id").orderBy(F.lit(1))
    numbered = rows.where("_alike").withColumn("_first", F.row_number().over(order) == 1)
    return rows.where("not _alike").unionByName(numbered).drop("_alike")


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """All but the first chunk of each chunk_id."""
    return _first_of_id(chunks).where("not _first").drop("_first")


def orphans(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources of chunks that the manifest doesn't have."""
    return chunks.select("source_id").distinct().join(manifest.select("source_id"), "source_id", "left_anti")


def chunk_errors(chunks: DataFrame, manifest: DataFrame, metadata: DataFrame, config: Chunking | None = None) -> DataFrame:
    """``chunks`` (of manifest sources) with ``errors``, an array of codes, and ``below_minimum``. A required column that isn't there is missing in every row."""
    config = config or Chunking()
    if "source_id" not in chunks.columns:
        raise AuditError("the chunks have no source_id")
    absent = [x for x in REQUIRED if x not in chunks.columns]
    chunks = chunks.withColumns({x: F.lit(None).cast(_TYPES.get(x, "string")) for x in absent})
    m = manifest.select("source_id", F.col("title").alias("_title"), F.coalesce("exclude_pages_from_index", F.array().cast("array<int>")).alias("_excluded"), F.col("include_page_ranges").alias("_ranges"))
    d = metadata.select("source_id", F.col("final_url").alias("_url"), F.col("sha256").alias("_sha"))
    rows = _first_of_id(chunks).join(m, "source_id").join(d, "source_id", "left")
    c = F.col
    body = text.strip(F.coalesce(c("text"), F.lit("")))
    tokens = text.estimate_tokens(body)
    pages = c("pages")
    lacking = reduce(lambda a, b: a | b, (c(x).isNull() for x in REQUIRED), F.lit(False))
    ordered = F.array_sort(F.array_distinct(pages)) == pages
    filled = F.size(pages) > 0
    outside = lambda p: ~F.exists(c("_ranges"), lambda r: p.between(r["start"], r["end"]))
    ends = (c("page_start") == F.try_element_at(pages, F.lit(1))) & (c("page_end") == F.try_element_at(pages, F.lit(-1)))
    checks: list[tuple[str, Column]] = [
        ("duplicate_chunk_id", ~c("_first")),
        ("title_mismatch", ~c("title").eqNullSafe(c("_title"))),
        ("url_mismatch", ~c("source_url").eqNullSafe(c("_url"))),
        ("hash_mismatch", ~c("source_sha256").eqNullSafe(c("_sha"))),
        ("empty_text", body == ""),
        ("stale_token_count", ~c("estimated_tokens").eqNullSafe(tokens)),
        ("over_maximum", tokens > config.maximum_estimated_tokens),
        ("pages_not_sorted_unique", ~(filled & ordered)),
        ("page_bounds_mismatch", filled & ordered & ~ends),
        ("excluded_pages", F.arrays_overlap(pages, c("_excluded"))),
        ("outside_ranges", (F.size("_ranges") > 0) & F.exists(pages, outside)),
        ("unknown_tags", F.size(F.array_except("safety_tags", F.array(*map(F.lit, fixed.SAFETY_TAGS)))) > 0),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), name) for name, test in checks)))
    errors = F.when(lacking, F.array(F.lit("missing_fields"))).otherwise(found)
    return rows.withColumns({"errors": errors, "below_minimum": ~lacking & (tokens < config.minimum_estimated_tokens)}).drop("_first", "_title", "_excluded", "_ranges", "_url", "_sha", *(x for x in absent if x != "chunk_id"))


def audit_report(checked: DataFrame) -> DataFrame:
    """Per source and overall (source_id null): chunks, unique ids, errors, soft-minimum and tag counts."""
    tags = F.array_distinct("safety_tags")
    return checked.rollup("source_id").agg(
        F.count("*").alias("chunks"),
        F.count_distinct("chunk_id").alias("unique_chunk_ids"),
        F.count_if("below_minimum").alias("below_soft_minimum"),
        F.sum(F.size("errors")).alias("errors"),
        *(F.count_if(F.array_contains(tags, t)).alias(t) for t in fixed.SAFETY_TAGS),
    )


def missing_sources(chunks: DataFrame, manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """Manifest sources without chunks or without metadata: source_id, no_chunks, no_metadata."""
    has = chunks.select("source_id").distinct().withColumn("_c", F.lit(True))
    known = metadata.select("source_id").distinct().withColumn("_m", F.lit(True))
    out = manifest.select("source_id").join(has, "source_id", "left").join(known, "source_id", "left")
    return out.select("source_id", F.col("_c").isNull().alias("no_chunks"), F.col("_m").isNull().alias("no_metadata")).where("no_chunks or no_metadata")


def gate(chunks: DataFrame, manifest: DataFrame, metadata: DataFrame, config: Chunking | None = None) -> DataFrame:
    """The report, if the corpus passed; else an error that names the kinds of failures."""
    checked = chunk_errors(chunks, manifest, metadata, config)
    kinds = [r[0] for r in checked.select(F.explode("errors").alias("e")).distinct().orderBy("e").toArrow().to_pandas().itertuples(index=False)]
    if not orphans(chunks, manifest).isEmpty():
        kinds.append("unexpected_source")
    if not missing_sources(chunks, manifest, metadata).isEmpty():
        kinds.append("missing_source")
    if kinds:
        raise AuditError(f"the corpus audit failed: {', '.join(kinds)}")
    return audit_report(checked)
