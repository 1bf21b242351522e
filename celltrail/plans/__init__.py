"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from celltrail.plans import data_quality, evaluation, linking, markers, matrices, training

    return [markers, linking, training, evaluation, matrices, data_quality]


def all_queries() -> dict[str, Query]:
    """Every query of the core by name."""
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    """SQL of the core's queries, by name."""
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
