"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Modules that register queries. Each has QUERIES and ORACLES.
MODULES = ("url_filter", "bpe", "mixing", "quality", "near_dedup", "media", "tool_calls", "exact_dedup", "pii", "hard_negatives", "toxicity", "alignment")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").ORACLES.items()}
