"""Registered queries, each next to the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

AREAS = ["rules", "metrics", "reconcile", "cleaning", "sources", "synth", "text", "checklist", "streaming"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for area in AREAS:
        part = getattr(import_module(f"registry.{area}"), attribute)
        repeated = merged.keys() & part.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
