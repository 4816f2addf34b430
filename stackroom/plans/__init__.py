"""Registered queries, grouped by area."""

from __future__ import annotations

from importlib import import_module

from .registry import REGISTRY, Query

AREAS = ("text_queries", "search_queries", "dedup_queries", "chunk_queries", "index_queries",
         "crawl_queries", "catalog_queries", "lifecycle_queries", "stream_queries")


def load_all() -> dict[str, Query]:
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return REGISTRY
