"""The registered queries of the core library and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("series", "scenes", "waterline", "selection", "raster", "seams", "surface", "shades", "files", "model")


def _gather(kind: str) -> dict:
    return {name: value for m in MODULES for name, value in getattr(import_module(f"shoalgrid.plans.{m}"), kind).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
