"""Registered queries over the given tables, one module for each topic."""

from __future__ import annotations

import importlib

MODULES = ["corpus", "repository", "vectors", "search", "events", "streams", "manuscripts", "groups", "listings", "titles", "text_search", "families", "scans", "verification", "forms", "facets", "stored"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"scholarlens.plans.{name}")
