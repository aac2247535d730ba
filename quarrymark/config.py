"""Typed defaults.  Every value below is a behavioural constant of the analytics, not a tuning knob of Spark."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class RetrievalDefaults:
    k1: float = 1.5
    b: float = 0.75
    top_k: int = 10
    lexical_k: int = 50
    dense_k: int = 50
    rrf_k: int = 60
    near_cosine: float = 0.97
    near_jaccard: float = 0.9
    overlap_merge: float = 0.8
    near_window: int = 50


@dataclass(frozen=True)
class FusionDefaults:
    top_k: int = 8
    floor: int = 2
    section_cap: int = 2
    max_intents: int = 4


@dataclass(frozen=True)
class ControllerDefaults:
    anchor_idf_floor: float = 1.0
    min_stability: float = 0.65
    min_worthiness: float = 0.5
    novelty_threshold: float = 0.25
    max_retrievals: int = 4
    reserve_final: int = 1
    cooldown_ms: int = 400
    min_content_terms: int = 2
    strong_anchor: float = 0.8
    suppress_confidence: float = 0.8
    quiet_ms: int = 600
    endpoint_ms: int = 3000
    idle_eviction_ms: int = 15 * 60 * 1000


@dataclass(frozen=True)
class AdaptiveDefaults:
    final_k: int = 8
    per_document: int = 3
    rare_idf: float = 1.5
    oov_ratio: float = 0.5
    coverage: float = 0.6
    min_gain: float = 0.05
    authority_gap: float = 0.3
    max_iterations: int = 3
    max_queries: int = 5
    max_results: int = 40
    max_latency_ms: int = 1500
    max_hops: int = 2
    schedule: tuple[int, ...] = (5, 10, 20)


@dataclass(frozen=True)
class ChunkDefaults:
    target_tokens: int = 180
    max_tokens: int = 300
    min_tokens: int = 25
    overlap_tokens: int = 40
    max_heading_words: int = 12


RETRIEVAL = RetrievalDefaults()
FUSION = FusionDefaults()
CONTROLLER = ControllerDefaults()
ADAPTIVE = AdaptiveDefaults()
CHUNKING = ChunkDefaults()


def override(defaults, *layers: dict):
    """Apply option layers in order (profile, environment, explicit); unknown names are an error."""
    known = {f.name for f in fields(defaults)}
    for layer in layers:
        unknown = set(layer) - known
        if unknown:
            raise ValueError(f"unknown option(s): {sorted(unknown)}")
        defaults = replace(defaults, **layer)
    return defaults
