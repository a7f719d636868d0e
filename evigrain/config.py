"""Settings with their bounds. ``load`` reads a JSON file, rejects unknown keys and checks every bound."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from .functions.fixed import DISCLAIMER


class ConfigError(ValueError):
    """A setting is missing, unknown or out of bounds."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class Chunking:
    chunker_version: int = 1
    minimum_estimated_tokens: int = 200
    target_estimated_tokens: int = 300
    maximum_estimated_tokens: int = 400
    overlap_estimated_tokens: int = 50
    skip_extraction_statuses: tuple[str, ...] = ("empty", "image_review_required")

    def validate(self) -> None:
        _need(0 < self.minimum_estimated_tokens <= self.target_estimated_tokens <= self.maximum_estimated_tokens, "chunk limits: 0 < minimum <= target <= maximum")
        _need(0 <= self.overlap_estimated_tokens < self.minimum_estimated_tokens, "overlap: 0 <= overlap < minimum")


@dataclass(frozen=True)
class Embedding:
    provider: str = "injected"
    model: str = "injected"
    dimensions: int = 768
    batch_size: int = 16
    timeout_seconds: int = 30
    maximum_attempts: int = 3
    minimum_batch_interval_seconds: float = 15.0


@dataclass(frozen=True)
class Search:
    bm25_candidates: int = 20
    dense_candidates: int = 20
    final_results: int = 10
    rrf_constant: int = 60


@dataclass(frozen=True)
class Augmentation:
    hyde_enabled: bool = True
    crag_enabled: bool = True
    correction_threshold: float = 0.65
    maximum_hypothesis_chars: int = 1200


@dataclass(frozen=True)
class Reranking:
    enabled: bool = True
    model: str = "injected"
    candidate_count: int = 10
    minimum_top_score: float = 0.20


@dataclass(frozen=True)
class Retrieval:
    retrieval_version: int = 2
    database_path: str = ""
    embedding: Embedding = field(default_factory=Embedding)
    search: Search = field(default_factory=Search)
    augmentation: Augmentation = field(default_factory=Augmentation)
    reranking: Reranking = field(default_factory=Reranking)

    def validate(self) -> None:
        e, s, a, r = self.embedding, self.search, self.augmentation, self.reranking
        _need(all(isinstance(x, bool) for x in (a.hyde_enabled, a.crag_enabled, r.enabled)), "switches must be true or false")
        _need(200 <= a.maximum_hypothesis_chars <= 2000, "maximum_hypothesis_chars: 200 to 2000")
        _need(0 <= r.minimum_top_score <= a.correction_threshold <= 1, "0 <= minimum_top_score <= correction_threshold <= 1")
        _need(r.enabled or not a.crag_enabled, "corrective retrieval needs reranking")
        _need(128 <= e.dimensions <= 3072, "dimensions: 128 to 3072")
        _need(1 <= e.batch_size <= 100, "batch_size: 1 to 100")
        _need(1 <= e.maximum_attempts <= 5, "maximum_attempts: 1 to 5")
        _need(0 <= e.minimum_batch_interval_seconds <= 60, "minimum_batch_interval_seconds: 0 to 60")
        _need(e.timeout_seconds > 0, "timeout_seconds must be positive")
        _need(min(s.bm25_candidates, s.dense_candidates, s.final_results, s.rrf_constant) > 0, "search limits must be positive")
        _need(s.final_results <= s.bm25_candidates + s.dense_candidates, "final_results exceeds the candidates")
        _need(1 <= r.candidate_count <= s.final_results, "candidate_count: 1 to final_results")


@dataclass(frozen=True)
class Generation:
    generation_version: int = 2
    provider: str = "injected"
    model: str = "injected"
    temperature: float = 0.1
    maximum_output_tokens: int = 1024
    timeout_seconds: int = 45
    maximum_attempts: int = 3
    maximum_validation_attempts: int = 2
    maximum_context_chunks: int = 5
    minimum_claim_token_overlap: float = 0.2
    minimum_claim_support_score: float = 0.2
    standard_disclaimer: str = DISCLAIMER

    def validate(self) -> None:
        _need(0 <= self.temperature <= 1, "temperature: 0 to 1")
        _need(128 <= self.maximum_output_tokens <= 4096, "maximum_output_tokens: 128 to 4096")
        _need(1 <= self.maximum_attempts <= 5, "maximum_attempts: 1 to 5")
        _need(1 <= self.maximum_validation_attempts <= 3, "maximum_validation_attempts: 1 to 3")
        _need(1 <= self.maximum_context_chunks <= 10, "maximum_context_chunks: 1 to 10")
        _need(0 <= self.minimum_claim_token_overlap <= 1 and 0 <= self.minimum_claim_support_score <= 1, "claim thresholds: 0 to 1")
        _need(bool(self.standard_disclaimer.strip()), "standard_disclaimer is blank")


def build(kind: type, values: dict[str, Any]) -> Any:
    """A settings object from plain values, nested ones included."""
    hints = get_type_hints(kind)
    known = {f.name for f in fields(kind)}
    _need(not set(values) - known, f"unknown settings: {sorted(set(values) - known)}")
    args = {k: build(hints[k], v) if is_dataclass(hints[k]) else tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    return kind(**args)


def load(kind: type, path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        out = build(kind, json.load(f))
    try:
        out.validate()
    except TypeError as e:
        raise ConfigError(str(e)) from e
    return out
