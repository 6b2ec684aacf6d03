"""All registered queries: name → (callable(spark, sf_dir) -> DataFrame, oracle SQL | None)."""

from __future__ import annotations

import importlib

CATALOGS = [
    "ebbflow.plans.catalog_segments",
    "ebbflow.plans.catalog_evaluate",
    "ebbflow.plans.catalog_stats",
    "ebbflow.plans.catalog_ops",
    "ebbflow.plans.catalog_events",
    "ebbflow.plans.catalog_models",
    "ebbflow.plans.catalog_clean",
    "ebbflow.plans.catalog_streams",
    "ebbflow.plans.catalog_whole",
    "ebbflow.plans.catalog_certificates",
]


def entries() -> dict:
    out = {}
    for mod in CATALOGS:
        out.update(importlib.import_module(mod).QUERIES)
    return out
