"""Registered queries; importing a module of this package registers its queries."""

from __future__ import annotations

import importlib

MODULES = ["crosssection", "relational", "aggregates", "factors", "validation", "risk", "actuarial", "storage", "trading", "graph_text", "stateful", "inference", "learning", "forecasts"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"alphaloom.plans.{name}")
