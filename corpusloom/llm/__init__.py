"""Operators of a training-data pipeline. Nothing else in the package imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ["bpe", "byte_bpe", "chat_format", "decontaminate", "fingerprint", "jaccard_join", "line_dedup", "lm_score", "periodic_runs", "sharding", "substring_dedup", "toxicity", "whitening"]


def _gathered(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), name).items()}


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLE_SQL")
