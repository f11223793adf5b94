"""All registered queries and oracles, by key."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hiresift.plans.tables import Tables

AREAS = ("q_text", "q_extract", "q_match", "q_screen", "q_evidence", "q_grounding", "q_funnel", "q_evaluate", "q_writing", "q_streaming")


def _areas():
    for name in AREAS:
        try:
            yield importlib.import_module(f"hiresift.plans.{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"hiresift.plans.{name}":
                raise


def run(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    for area in _areas():
        if key in area.QUERIES:
            return area.QUERIES[key](Tables(spark, sf_dir))
    raise KeyError(key)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return {key: bind(fn) for area in _areas() for key, fn in area.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {key: sql for area in _areas() for key, sql in area.ORACLES.items()}
