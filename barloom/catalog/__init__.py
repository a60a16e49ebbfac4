"""All registered queries with their oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = ("timeseries", "crosssection", "aggregates", "statistics", "joining", "labelling",
           "projections", "quality", "recurrences", "scores",
           "backtests", "ledgers", "sourcing", "sinking", "learning", "streams")


def load():
    from . import base
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return base.QUERIES, base.ORACLES
