"""All queries of this subpackage, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["sentences", "cutoffs", "splits", "languages", "neardup", "template", "encoding", "mixing", "subjects"]


def collect(attribute: str) -> dict:
    """The merged `attribute` (QUERIES or SQL) of all query modules."""
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"lexspan.llm.{name}"), attribute)
    return out
