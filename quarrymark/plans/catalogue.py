"""Imports every query module once so that the registry is complete."""

from __future__ import annotations

import importlib

from quarrymark.plans.registry import CATALOGUE, builders, statements

MODULES = (
    "lexical_queries",
    "dense_queries",
    "fusion_queries",
    "corpus_queries",
    "text_queries",
    "filter_queries",
    "event_queries",
    "state_queries",
    "metric_queries",
    "claim_queries",
    "adaptive_queries",
    "dialogue_queries",
    "session_queries",
    "need_queries",
    "structure_queries",
    "register_queries",
    "stated_queries",
)

for _module in MODULES:
    importlib.import_module(f"quarrymark.plans.{_module}")

__all__ = ["CATALOGUE", "builders", "statements"]
