"""Safe retrieval for batches of queries: screen, search, rerank, correct once, prune, gate.

Every query ends with a status; a failing provider or a bad score concerns its own
queries only. Each provider result is settled before more than one branch reads it,
and the second pass runs over the weak queries alone (not at all if there are none).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions import analyze, fixed, safety
from ..operators import fusion, lexical, rerank
from ..operators.vectors import Provider, embed_queries
from ..sources.store import Index, settled

TextModel = Callable[[list[str]], list[str | None]]


@dataclass(frozen=True)
class Providers:
    """Injected models: ``scorer`` (query, text) -> logit Column; the others map lists. Any may be absent."""

    scorer: rerank.Scorer | None = None
    embed_query: Provider | None = None
    embed_document: Provider | None = None
    hypothesize: TextModel | None = None
    rewrite: TextModel | None = None
    generate: TextModel | None = None
    repair: TextModel | None = None
    support: Callable[[Column, Column], Column] | None = None


def asked(df: DataFrame, text_col: str, model: TextModel, out: str) -> DataFrame:
    """``df`` plus the model's answer for each row; a batch that fails, or an answer that is no string, is null."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            try:
                got = [x if isinstance(x, str) else None for x in model(list(f[text_col]))]
            except Exception:
                got = [None] * len(f)
            yield f.assign(**{out: pd.Series(got, index=f.index, dtype=object)})

    return df.mapInPandas(run, schema)


def screened(queries: DataFrame, nfkc: bool = True) -> DataFrame:
    """``queries`` (query_id, query) with the struct ``safety``."""
    q = F.coalesce(F.col("query"), F.lit(""))
    normal = safety.normalize_query(analyze.nfkc(q) if nfkc else q)
    return queries.withColumn("_n", normal).withColumn("safety", safety.input_decision(F.col("_n"))).drop("_n")


def _terms(c: Column, index: Index) -> Column:
    """Query words, cut like the index's terms."""
    return index.analyser(F.array_join(lexical.query_terms(c, analyze.casefold(c)), " "))


def search(index: Index, queries: DataFrame, config: Retrieval, vectors: DataFrame | None, hypothetical: DataFrame | None, sources: tuple[str, ...] | None) -> DataFrame:
    """``queries`` (query_id, search) -> ranked full rows with the query."""
    q = queries.select("query_id", _terms(F.col("search"), index).alias("terms"))
    ranks = fusion.hybrid(index.lexical or index.chunks, q, config.search, "chunk_id", index.vectors if vectors is not None else None, vectors, hypothetical, sources, analyser=index.analyser)
    return fusion.materialised(ranks, index.chunks.drop("terms"))


def retrieve(queries: DataFrame, index: Index, config: Retrieval | None = None, providers: Providers | None = None, sources: tuple[str, ...] | None = None, nfkc: bool = True) -> tuple[DataFrame, DataFrame]:
    """(outcomes, results).

    outcomes: query_id, query, safety, status (refused, error, evidence_retrieved,
    insufficient_evidence), message, retrieval_mode, reranking_status, top_confidence,
    initial_top_score, hyde_status, correction_status, removed_chunks. results: the
    evidence rows of queries with status evidence_retrieved, with ``rank``.
    """
    config, p = config or Retrieval(), providers or Providers()
    screen = settled(screened(queries, nfkc))
    expanded = F.col("safety.retrieval_query")
    ok = screen.where("safety.allowed").withColumn("search", lexical.valid_query(expanded))
    # An expansion may pass the length limit, and a query may have no word at all: both are errors of that query alone.
    live = ok.where(F.col("search").isNotNull() & (F.size(lexical.query_terms(F.col("search"))) > 0)).select("query_id", F.col("safety.normalized_query").alias("normalized"), "search")
    vectors, hyde, hypothetical = None, live.select("query_id", F.lit("disabled").alias("hyde_status")), None
    modes = live.select("query_id", F.lit("lexical").alias("retrieval_mode"))
    if p.embed_query is not None:
        got = settled(embed_queries(live.select("query_id", F.col("search").alias("query")), p.embed_query))
        vectors = got.where("vector is not null")
        modes = got.select("query_id", F.when(F.col("vector").isNull(), "lexical_fallback").otherwise("hybrid").alias("retrieval_mode"))
    if config.augmentation.hyde_enabled:
        hyde = live.select("query_id", F.lit("unavailable").alias("hyde_status"))
        if p.hypothesize is not None and p.embed_document is not None and vectors is not None:
            made = asked(live.select("query_id", "normalized"), "normalized", p.hypothesize, "passage")
            fits = F.length(F.trim("passage")).between(1, config.augmentation.maximum_hypothesis_chars)
            made = settled(made.withColumn("passage", F.when(fits, F.col("passage"))))
            titled = made.where("passage is not null").select("query_id", F.concat(F.lit("Title: Hypothetical search passage\n\n"), F.col("passage")).alias("query"))
            embedded = settled(embed_queries(titled, p.embed_document)).where("vector is not null")
            hypothetical = embedded.join(vectors.select("query_id"), "query_id", "left_semi")
            state = live.select("query_id").join(embedded.select("query_id", F.lit(True).alias("_e")), "query_id", "left").join(vectors.select("query_id", F.lit(True).alias("_v")), "query_id", "left")
            hyde = state.select("query_id", F.when(F.col("_e").isNull(), "failed_fallback").when(F.col("_v").isNull(), "discarded_embedding_failure").otherwise("applied").alias("hyde_status"))
    found = search(index, live, config, vectors, hypothetical, sources).join(live.select("query_id", F.col("search").alias("query")), "query_id")
    least = config.reranking.minimum_top_score
    if not config.reranking.enabled or p.scorer is None:
        results = settled(found.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rank", F.col("fused_rank")))
        has = results.select("query_id").distinct().withColumn("_r", F.lit(True))
        status = F.when(F.col("_r").isNull(), "insufficient_evidence").otherwise("evidence_retrieved")
        gate = live.select("query_id").join(has, "query_id", "left").select("query_id", status.alias("status"), F.lit(None).cast("double").alias("top_confidence"), F.lit(0).cast("long").alias("removed_chunks"))
        notes = live.select("query_id", F.lit(None).cast("double").alias("initial_top_score"), F.lit("disabled").alias("correction_status"))
        reranking = F.lit("disabled")
    else:
        first = settled(rerank.rerank(found, p.scorer, config.reranking.candidate_count))
        pool, notes = first.withColumn("rank", F.col("rerank_rank")), None
        top = live.select("query_id").join(first.groupBy("query_id").agg(F.max("rerank_score").alias("initial_top_score")), "query_id", "left")
        if config.augmentation.crag_enabled:
            weak = settled(rerank.weak_queries(live, first, config.augmentation.correction_threshold))
            pool, notes = _corrected(index, live, weak, first, config, p, vectors, hypothetical, sources, nfkc)
        pool = settled(pool)
        gate = rerank.gated(live, pool, least, config.augmentation.crag_enabled)
        default = "not_needed" if config.augmentation.crag_enabled else "disabled"
        notes = (top.join(notes, "query_id", "left") if notes is not None else top.withColumn("correction_status", F.lit(None).cast("string"))).withColumn("correction_status", F.coalesce("correction_status", F.lit(default)))
        passed = gate.where("status = 'evidence_retrieved'").select("query_id")
        results = pool.join(passed, "query_id", "left_semi")
        if config.augmentation.crag_enabled:
            results = results.where(F.col("rerank_score") >= F.lit(least))
        reranking = F.when(F.col("status") == "unavailable", "unavailable").otherwise("applied")
    done = gate.join(modes, "query_id", "left").join(hyde, "query_id", "left").join(notes, "query_id", "left").withColumn("reranking_status", reranking)
    done = done.withColumn("correction_status", F.when(F.col("status") == "unavailable", "unavailable").otherwise(F.col("correction_status"))).withColumn("status", F.when(F.col("status") == "unavailable", "insufficient_evidence").otherwise(F.col("status")))
    outcomes = screen.join(done, "query_id", "left")
    state = F.when(~F.col("safety.allowed"), "refused").when(F.col("status").isNull(), "error").otherwise(F.col("status"))
    message = F.when(~F.col("safety.allowed"), F.col("safety.refusal_message")).when(state == "error", lexical.QUERY_ERROR).when(state == "insufficient_evidence", fixed.OUT_OF_SCOPE_REFUSAL)
    return outcomes.withColumns({"status": state, "message": message, "retrieval_mode": F.coalesce("retrieval_mode", F.lit("not_run")), "removed_chunks": F.coalesce("removed_chunks", F.lit(0).cast("long"))}), results


def _corrected(index: Index, live: DataFrame, weak: DataFrame, first: DataFrame, config: Retrieval, p: Providers, vectors: DataFrame | None, hypothetical: DataFrame | None, sources: tuple[str, ...] | None, nfkc: bool) -> tuple[DataFrame, DataFrame]:
    """One corrective pass over weak queries: (results of all queries, query_id and correction_status)."""
    initial = first.withColumn("rank", F.col("rerank_rank"))
    if weak.isEmpty():
        return initial, weak.select("query_id", F.lit("not_needed").alias("correction_status"))
    again = live.join(weak.select("query_id"), "query_id", "left_semi")
    if p.rewrite is None:
        again = again.withColumn("corrected", F.col("search")).withColumn("correction_status", F.lit("broadened"))
    else:
        made = settled(asked(again, "normalized", p.rewrite, "rewritten"))
        made = screened(made.withColumn("query", F.col("rewritten")), nfkc)
        good = F.length(F.trim("rewritten")).between(1, fixed.MAX_QUERY_CHARS) & F.col("safety.allowed")
        new = lexical.valid_query(F.col("safety.retrieval_query"))
        good = F.coalesce(good & new.isNotNull() & (F.size(lexical.query_terms(new)) > 0), F.lit(False))
        again = made.withColumn("corrected", F.when(good, new).otherwise(F.col("search"))).withColumn("correction_status", F.when(good, "rewritten").otherwise("rewrite_failed_broadened"))
    again = settled(again.select("query_id", "search", "corrected", "correction_status"))
    s = config.search
    wider = replace(config, search=replace(s, bm25_candidates=min(100, s.bm25_candidates * 2), dense_candidates=min(100, s.dense_candidates * 2), final_results=min(20, s.final_results * 2)))
    fallback = None
    if p.embed_query is not None and vectors is not None:
        # Queries whose first embedding failed stay lexical; a correction that can't be embedded is searched by words.
        got = settled(embed_queries(again.join(vectors.select("query_id"), "query_id", "left_semi").select("query_id", F.col("corrected").alias("query")), p.embed_query))
        vectors = got.where("vector is not null")
        fallback = got.where("vector is null").select("query_id", F.lit("_lexical_fallback").alias("suffix"))
        if hypothetical is not None:
            hypothetical = hypothetical.join(vectors.select("query_id"), "query_id", "left_semi")
    found = search(index, again.select("query_id", F.col("corrected").alias("search")), wider, vectors, hypothetical, sources)
    # Relevance is always judged against the original query.
    scored = settled(rerank.rescored(found.join(again.select("query_id", F.col("search").alias("query")), "query_id"), p.scorer))
    both = rerank.merged(first.join(weak.select("query_id"), "query_id", "left_semi").drop("rerank_rank"), scored, s.final_results).withColumn("rank", F.col("rerank_rank"))
    strong = initial.join(weak.select("query_id"), "query_id", "left_anti")
    notes = again.select("query_id", "correction_status")
    if fallback is not None:
        notes = notes.join(fallback, "query_id", "left").select("query_id", F.concat("correction_status", F.coalesce("suffix", F.lit(""))).alias("correction_status"))
    return strong.unionByName(both, allowMissingColumns=True).drop("pass"), notes
