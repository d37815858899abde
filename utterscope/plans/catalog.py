"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

import importlib

from utterscope.plans.registry import ORACLES, QUERIES

_MODULES = ["q_scoring", "q_metrics", "q_prep", "q_splits", "q_geometry",
            "q_topics", "q_models", "q_discovery", "q_jobs"]

for _m in _MODULES:
    importlib.import_module(f"utterscope.plans.{_m}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
