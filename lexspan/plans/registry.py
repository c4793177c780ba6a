"""All queries of the core, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["orphans", "relational", "spans", "metrics", "datasets", "search", "tfidf", "files"]


def collect(attribute: str) -> dict:
    """The merged `attribute` (QUERIES or SQL) of all query modules."""
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"lexspan.plans.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"queries defined twice: {sorted(clash)}")
        out |= part
    return out
