"""All registered queries, collected from the area modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AREAS = ["fairness", "prepare", "drift", "text_bias", "mitigation", "counterfactual", "causal", "graph", "streaming", "models", "sources"]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for area in AREAS:
        try:
            module = importlib.import_module(f"fairspark.plans.{area}_queries")
        except ModuleNotFoundError as exc:
            if exc.name != f"fairspark.plans.{area}_queries":
                raise
            continue
        out.update(module.QUERIES)
    return out
