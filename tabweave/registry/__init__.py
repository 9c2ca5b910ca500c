"""Registered queries: one per operator of the survey inventory.

Each area module exposes ``QUERIES: dict[name, (callable(spark, sf_dir), oracle_sql | None)]``.
Every query reads the driver tables (or frames Spark derives from them) in full.
"""

from __future__ import annotations

from importlib import import_module

AREAS = ["matching", "prepare", "functions", "splits", "augment", "metrics", "runs", "features",
         "sources", "learning"]


def all_queries() -> dict:
    out = {}
    for area in AREAS:
        for k, v in import_module(f"{__name__}.{area}").QUERIES.items():
            if k in out:
                raise KeyError(f"duplicate query name {k}")
            out[k] = v
    return out
