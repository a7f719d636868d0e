"""Rule classifiers as single CASE expressions: input guardrails, output safety, confidence labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import squeeze

_ALLOWED = "allowed_guideline_query"


def normalize_query(c: Column) -> Column:
    """Control, format, private and unassigned characters but newline and tab go; white space collapses. NFKC (``analyze.nfkc``) comes before."""
    return squeeze(F.regexp_replace(c, r"[\p{C}&&[^\n\t]]", ""))


def expand_abbreviations(c: Column) -> Column:
    for short, long in fixed.ABBREVIATIONS.items():
        c = F.regexp_replace(c, fixed.java(rf"\b{short}\b"), long)
    return c


def input_category(normalized: Column) -> Column:
    """Category of a normalised query; the first rule that holds decides."""
    has = lambda p: normalized.rlike(fixed.java(p))
    personal = has(fixed.PERSONAL_CONTEXT)
    return (
        F.when(normalized.isNull() | (normalized == "") | (F.length(normalized) > fixed.MAX_QUERY_CHARS), "invalid_input")
        .when((personal | has(fixed.IMMEDIATE_PERSON)) & has(fixed.EMERGENCY_SIGNAL), "emergency")
        .when(has(fixed.PERSONAL_RECORD), "personal_medical_data")
        .when(has(fixed.DOSAGE_REQUEST), "dosage")
        .when(has(fixed.TREATMENT_REQUEST), "personalized_treatment")
        .when(has(fixed.DIAGNOSIS_REQUEST) | (personal & has(fixed.SYMPTOM_OR_RESULT)), "diagnosis")
        .when(has(fixed.NONMEDICAL_TOPIC), "outside_corpus")
        .otherwise(_ALLOWED)
    )


def refusal_message(category: Column) -> Column:
    return (
        F.when(category == _ALLOWED, F.lit(None).cast("string"))
        .when(category == "invalid_input", fixed.INVALID_INPUT_REFUSAL)
        .when(category == "emergency", fixed.EMERGENCY_REFUSAL)
        .when(category == "outside_corpus", fixed.OUT_OF_SCOPE_REFUSAL)
        .otherwise(fixed.PERSONALIZED_REFUSAL)
    )


def input_decision(normalized: Column) -> Column:
    """struct(allowed, category, normalized_query, retrieval_query, refusal_message)."""
    category = input_category(normalized)
    allowed = category == _ALLOWED
    return F.struct(
        allowed.alias("allowed"),
        category.alias("category"),
        F.coalesce(normalized, F.lit("")).alias("normalized_query"),
        F.when(allowed, expand_abbreviations(normalized)).alias("retrieval_query"),
        refusal_message(category).alias("refusal_message"),
    )


def _forbidden(text: str | None) -> bool:
    if not text:
        return False
    around = fixed.DOSAGE_CONTEXT_CHARS
    for m in _DOSAGE.finditer(text):
        near = text[max(0, m.start() - around) : m.end() + around]
        if _MEDICATION.search(near) or not _LIFESTYLE.search(near):
            return True
    return False


_DOSAGE, _LIFESTYLE, _MEDICATION = (re.compile(p, re.IGNORECASE) for p in (fixed.DOSAGE_OUTPUT, fixed.LIFESTYLE_CONTEXT, fixed.MEDICATION_CONTEXT))


def dosage_in_context(c: Column) -> Column:
    """Does a dose stand outside a lifestyle context? Match offsets decide, so this one is an Arrow UDF."""

    @F.pandas_udf("boolean")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_forbidden).astype(bool)

    return scan(c)


def output_category(text: Column, dosage: Column | None = None) -> Column:
    """``dosage``: whether the text has a forbidden dose, by default ``dosage_in_context``."""
    return (
        F.when(dosage_in_context(text) if dosage is None else dosage, "medication_dosage")
        .when(text.rlike(fixed.java(fixed.EMERGENCY_OUTPUT)), "emergency_guidance")
        .when(text.rlike(fixed.java(fixed.PERSONALIZED_OUTPUT)), "personalized_advice")
        .otherwise("allowed")
    )


def confidence(scores: Column) -> Column:
    """struct(level, score) of an array of doubles: the least score, unless one is missing or outside 0..1."""
    bad = F.size(scores) < 1
    bad = bad | F.exists(scores, lambda s: s.isNull() | F.isnan(s) | (s < 0) | (s > 1))
    least = F.array_min(scores)
    level = F.when(scores.isNull() | bad, "not_assessed").when(least >= F.lit(fixed.HIGH_CONFIDENCE), "high").when(least >= F.lit(fixed.MODERATE_CONFIDENCE), "moderate").otherwise("low")
    return F.struct(level.alias("level"), F.when(level != "not_assessed", least).alias("score"))
