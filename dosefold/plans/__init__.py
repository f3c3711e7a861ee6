"""Queries bound to the given tables, one module per operator group."""

from __future__ import annotations

from importlib import import_module

GROUPS = [
    "evaluation", "matrix", "structures", "cohort", "criteria", "objectives",
    "grids", "geometry", "arcs", "prediction", "sources", "own_grids",
]


def load_all():
    from dosefold.plans import registry

    for group in GROUPS:
        import_module(f"dosefold.plans.{group}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
