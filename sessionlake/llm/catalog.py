"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("exact_dedup", "mixing", "merkle", "chat", "bpe", "bagminhash", "toxicity", "quality", "brown", "repeats", "manifest", "licenses", "phrases")


def _all(kind: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), kind).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
