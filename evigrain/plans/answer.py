"""Batch answering: retrieve, generate, validate, repair what failed, report a status for every query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Generation, Retrieval
from ..functions import fixed
from ..operators import grounding
from ..sources.store import Index, settled
from .retrieve import Providers, asked, retrieve


def answer(queries: DataFrame, index: Index, retrieval: Retrieval | None = None, generation: Generation | None = None, providers: Providers | None = None, nfkc: bool = True) -> DataFrame:
    """The retrieval outcome of each query with answer_status, answer_message, claims, confidence, diagnostic, attempts.

    Refused queries meet no provider. Each pass asks only for queries that the pass
    before left invalid; after the last one they are ``output_blocked``.
    """
    generation, p = generation or Generation(), providers or Providers()
    if p.generate is None:
        raise ValueError("answering needs a generator")
    outcomes, results = retrieve(queries, index, retrieval, p, nfkc=nfkc)
    outcomes = settled(outcomes)
    evidence = settled(grounding.evidence_arrays(results, generation.maximum_context_chunks))
    open_ = outcomes.select("query_id", F.col("safety.normalized_query").alias("normalized")).join(evidence, "query_id")
    open_ = settled(open_.select("query_id", grounding.prompt(F.col("normalized"), F.col("evidence")).alias("prompt")))
    done = None
    for attempt in range(1, generation.maximum_validation_attempts + 1):
        model = p.repair if attempt > 1 and p.repair is not None else p.generate
        payloads = settled(asked(open_, "prompt", model, "payload"))
        checked = grounding.validated(payloads.where("payload is not null").select("query_id", "payload"), evidence, generation, p.support)
        failed = payloads.where("payload is null").select("query_id").withColumns({"status": F.lit("failed"), "error": F.lit("generation failed"), "disclaimer": F.lit(generation.standard_disclaimer)})
        checked = settled(checked.unionByName(failed, allowMissingColumns=True).withColumn("attempts", F.lit(attempt)))
        last = attempt == generation.maximum_validation_attempts
        final = checked if last else checked.where("status <> 'invalid'")
        done = final if done is None else done.unionByName(final)
        if last:
            break
        open_ = open_.join(checked.where("status = 'invalid'").select("query_id"), "query_id", "left_semi")
        if open_.isEmpty():
            break
    out = outcomes.join(done.withColumnsRenamed({"status": "_said", "error": "_error"}), "query_id", "left")
    blocked = F.col("_said").isin("invalid", "failed")
    status = F.when(F.col("_said").isNull(), F.col("status")).when(blocked, "output_blocked").otherwise(F.col("_said"))
    message = F.when(F.col("_said").isNull(), F.col("message")).when(status != "answered", fixed.OUT_OF_SCOPE_REFUSAL)
    out = out.withColumns({"answer_status": status, "answer_message": message, "diagnostic": F.when(blocked, F.col("_error")), "attempts": F.coalesce("attempts", F.lit(0))})
    return out.withColumn("claims", F.when(F.col("answer_status") == "answered", F.col("claims"))).withColumn("confidence", grounding.answer_confidence(F.col("claims"))).drop("_said", "_error")
