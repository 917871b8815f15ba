"""Registered queries: every operator run over the whole benchmark tables, with result-check SQL."""

from __future__ import annotations

from importlib import import_module

from shutterlake.queries.registry import REGISTRY, Query

_MODULES = ["files", "metadata", "similarity", "detection", "triage", "upkeep", "browsing",
            "social", "users", "library_figures", "moves", "streams"]


def all_queries() -> dict[str, Query]:
    for name in _MODULES:
        import_module(f"shutterlake.queries.{name}")
    return dict(REGISTRY)


__all__ = ["Query", "all_queries"]
