"""The registered queries and their rows in DuckDB's SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "i2_transition_tensor"


def query(oracle: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


MODULES = ("shaping", "imputation", "indices", "spatial", "events", "quality", "dynamics", "sequences", "shocks", "regression", "metrics", "monitoring", "sources", "estimators", "learning", "trajectories", "phase", "inferred", "validity", "responses", "trees")
for _module in MODULES:
    importlib.import_module(f"tessella.plans.{_module}_queries")
