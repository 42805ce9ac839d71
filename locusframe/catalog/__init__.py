"""Every registered query and its oracle SQL."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("genotypes", "markers", "pedigrees", "segments", "replicates", "sources")


def all_queries() -> dict:
    merged: dict = {}
    for topic in TOPICS:
        merged.update(import_module(f"locusframe.catalog.{topic}").QUERIES)
    return merged


def all_oracles() -> dict[str, str]:
    merged: dict[str, str] = {}
    for topic in TOPICS:
        merged.update(import_module(f"locusframe.catalog.{topic}").ORACLES)
    return merged
