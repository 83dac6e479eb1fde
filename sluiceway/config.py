"""Thresholds of the question-answering engine; a variant is made with ``dataclasses.replace``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults are the published ones; ages are in hours, costs in units."""

    now: str = "2026-09-13 00:00:00"
    max_age_hours: float = 48.0
    top_k: int = 5
    k1: float = 1.5
    b: float = 0.75
    min_score: float = 1.15
    min_cosine: float = 0.08
    dense_weight: float = 0.30
    grounding: float = 0.52
    draft_grounding: float = 0.50
    support_floor: float = 0.15
    answer_sentences: int = 2
    disagreement_k: int = 1
    disagreement_jaccard: float = 1.0
    session_budget: float = 5.0
    write_confidence: float = 0.65
    nonkey_rule: str = "all"
