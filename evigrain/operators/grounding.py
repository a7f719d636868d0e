"""Prompts, and strict validation of generated claims against the evidence they cite.

A payload is JSON text. It is parsed as a variant, so that wrong types are seen and
not silently cast. Evidence is a handful of rows per query (the context limit), so it
travels as one array; claims and citations are then checked by array expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Generation
from ..functions import fixed, safety, text

_CLAIM_SHAPE = "OBJECT<chunk_ids: ARRAY<STRING>, text: STRING>"
Support = Callable[[Column, Column], Column]


def evidence_arrays(evidence: DataFrame, most: int) -> DataFrame:
    """``evidence`` (query_id, chunk_id, source_id, title, source_url, pages, text, rerank_score, rank) -> query_id, evidence: the first ``most`` in order of rank."""
    row = F.struct("rank", "chunk_id", "source_id", "title", "source_url", "pages", "text", "rerank_score")
    return evidence.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("evidence"))


def prompt(query: Column, evidence: Column) -> Column:
    """The question and its evidence blocks."""

    def block(e: Column) -> Column:
        pages = F.concat(F.lit("["), F.array_join(F.transform(e["pages"], lambda p: p.cast("string")), ", "), F.lit("]"))
        quoted = F.substring_index(F.substring(F.to_json(F.struct(e["chunk_id"].alias("i"))), 6, 1 << 30), "}", 1)
        return F.concat_ws("\n", F.concat(F.lit("<chunk id="), quoted, F.lit(">")), F.concat(F.lit("title: "), e["title"]), F.concat(F.lit("source_id: "), e["source_id"]), F.concat(F.lit("pages: "), pages), e["text"], F.lit("</chunk>"))

    return F.concat(F.lit("Question: "), query, F.lit("\n\nEvidence follows. Use only these chunks.\n\n"), F.array_join(F.transform(evidence, block), "\n\n"))


def validated(payloads: DataFrame, evidence: DataFrame, config: Generation | None = None, support: Support | None = None, dosage: Column | None = None) -> DataFrame:
    """``payloads`` (query_id, payload), ``evidence`` (query_id, evidence) -> query_id, status, error, claims, disclaimer.

    ``status`` is answered, insufficient_evidence, or invalid with the first error; claims are
    numbered from 1. ``support`` scores (claim, cited text). ``dosage`` replaces the
    context-aware dose check on the column ``claim_text``.
    """
    config = config or Generation()
    v = F.try_parse_json(F.col("payload"))
    keys = F.array_sort(F.json_object_keys("payload"))
    raw = F.try_variant_get(v, "$.claims", "array<variant>")
    status = F.when(F.schema_of_variant(F.try_variant_get(v, "$.status", "variant")) == "STRING", F.try_variant_get(v, "$.status", "string"))
    top = payloads.join(evidence, "query_id", "left").select("query_id", keys.alias("keys"), status.alias("said"), raw.alias("raw"), F.coalesce("evidence", F.lit(None)).alias("evidence"))
    n = F.size("raw")
    top_error = (
        F.when(F.col("keys").isNull() | (F.col("keys") != F.array(F.lit("claims"), F.lit("status"))), "unexpected top-level fields")
        .when(F.col("said").isNull() | ~F.col("said").isin("answered", "insufficient_evidence") | F.col("raw").isNull(), "invalid status or claims")
        .when((F.col("said") == "insufficient_evidence") & (n > 0), "insufficient response with claims")
        .when((F.col("said") == "answered") & ~n.between(1, fixed.MAX_CLAIMS), f"not 1 to {fixed.MAX_CLAIMS} claims")
    )
    top = top.withColumn("top_error", top_error)
    asked = top.where("top_error is null").select("query_id", "evidence", F.posexplode("raw").alias("i", "claim"))
    c = F.col("claim")
    shape = F.schema_of_variant(c)
    parts = asked.select(
        "query_id",
        "evidence",
        (F.col("i") + 1).alias("claim_index"),
        shape.alias("shape"),
        F.array_sort(F.json_object_keys(F.to_json(c))).alias("fields"),
        F.when(F.schema_of_variant(F.try_variant_get(c, "$.text", "variant")) == "STRING", F.try_variant_get(c, "$.text", "string")).alias("claim_text"),
        F.try_variant_get(c, "$.chunk_ids", "array<string>").alias("chunk_ids"),
    )
    parts = parts.withColumn("cited", F.transform("chunk_ids", lambda x: F.get(F.filter("evidence", lambda e: e["chunk_id"] == x), F.lit(0))))
    parts = parts.withColumn("cited_text", F.array_join(F.transform("cited", lambda e: e["text"]), " "))
    parts = parts.withColumn("output", safety.output_category(F.col("claim_text"), dosage))
    parts = parts.withColumn("support_score", support(F.col("claim_text"), F.col("cited_text")) if support else F.lit(None).cast("double"))
    ids, said = F.col("chunk_ids"), F.col("claim_text")
    weak = (~F.coalesce(F.col("support_score").between(0, 1) & (F.col("support_score") >= F.lit(config.minimum_claim_support_score)), F.lit(False))) if support else F.lit(False)
    what = (
        F.when(F.col("fields").isNull() | (F.col("fields") != F.array(F.lit("chunk_ids"), F.lit("text"))), "invalid fields")
        .when(said.isNull() | ~F.length(text.strip(said)).between(1, fixed.MAX_CLAIM_CHARS), "text is invalid")
        .when(F.col("output") != "allowed", F.concat(F.lit("failed output safety: "), F.col("output")))
        .when(ids.isNull() | (F.size(ids) < 1), "no citations")
        .when(F.col("shape") != _CLAIM_SHAPE, "invalid citation ids")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated citation ids")
        .when(F.exists("cited", lambda e: e["chunk_id"].isNull()), "unknown chunks")
        .when(text.claim_overlap(said, F.col("cited_text")) < F.lit(config.minimum_claim_token_overlap), "insufficient lexical overlap")
        .when(weak, "insufficient support")
    )
    scores = F.concat(F.array("support_score"), F.transform("cited", lambda e: e["rerank_score"]))
    citation = lambda e: F.struct(e["chunk_id"].alias("chunk_id"), e["source_id"].alias("source_id"), e["title"].alias("title"), e["source_url"].alias("source_url"), e["pages"].alias("pages"))
    parts = parts.withColumn("what", what)
    claim = F.struct("claim_index", text.strip(said).alias("text"), F.transform("cited", citation).alias("citations"), safety.confidence(scores).alias("confidence"))
    per = parts.groupBy("query_id").agg(
        F.min_by(F.concat(F.lit("claim "), F.col("claim_index").cast("string"), F.lit(": "), F.col("what")), F.when(F.col("what").isNotNull(), F.col("claim_index"))).alias("claim_error"),
        F.array_sort(F.collect_list(claim), lambda a, b: a["claim_index"] - b["claim_index"]).alias("claims"),
    )
    out = top.select("query_id", "said", "top_error").join(per, "query_id", "left")
    error = F.coalesce("top_error", "claim_error")
    return out.select("query_id", F.when(error.isNull(), F.col("said")).otherwise("invalid").alias("status"), error.alias("error"), F.when(error.isNull(), F.col("claims")).alias("claims"), F.lit(config.standard_disclaimer).alias("disclaimer"))


def answer_confidence(claims: Column) -> Column:
    """Label over all claims' scores."""
    return safety.confidence(F.transform(claims, lambda c: c["confidence"]["score"]))


def distinct_citations(answers: DataFrame) -> DataFrame:
    """Per query the citations in order of first use, equal (title, url, pages) once: query_id, position, title, source_url, pages."""
    from pyspark.sql import Window

    rows = answers.select("query_id", F.posexplode("claims").alias("ci", "claim")).select("query_id", "ci", F.posexplode("claim.citations").alias("xi", "x"))
    rows = rows.select("query_id", "ci", "xi", "x.title", "x.source_url", "x.pages")
    first = F.row_number().over(Window.partitionBy("query_id", "title", "source_url", "pages").orderBy("ci", "xi"))
    kept = rows.withColumn("_n", first).where("_n = 1")
    return kept.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("ci", "xi")).alias("position"), "title", "source_url", "pages")
