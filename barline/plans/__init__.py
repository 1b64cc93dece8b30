"""Queries over the driver tables, one per operator, with their check SQL."""

from importlib import import_module

from barline.plans.registry import QUERIES

MODULES = ["news", "feeds", "panel", "perf", "screen", "risk", "study", "model", "live", "stores"]


def load() -> dict:
    for name in MODULES:
        import_module(f"barline.plans.{name}")
    return QUERIES
