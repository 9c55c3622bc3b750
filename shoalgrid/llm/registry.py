"""The subpackage's queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality_rules", "mixing", "quality_model", "toxicity", "chat", "bpe", "pii", "simhash", "substring_dedup", "exact_dedup")


def _gather(kind: str) -> dict:
    return {name: value for m in MODULES for name, value in getattr(import_module(f"shoalgrid.llm.{m}"), kind).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
