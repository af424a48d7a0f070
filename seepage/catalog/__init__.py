"""Named queries over the test tables and their SQL equivalents."""

from __future__ import annotations

import importlib

GROUPS = (
    "audit",
    "extractors",
    "cleaning",
    "sampling",
    "tokens",
    "language_model",
    "private",
    "metrics",
    "files",
)


def collect(kind: str) -> dict:
    """``QUERIES`` or ``ORACLES`` of all groups, merged."""
    merged: dict = {}
    for group in GROUPS:
        merged.update(getattr(importlib.import_module(f"seepage.catalog.{group}"), kind))
    return merged
