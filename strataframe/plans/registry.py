"""All queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataframe.plans import documents, evidence, ledgers, packets, problems, projections, snapshots, timelines

_MODULES = [problems, snapshots, timelines, documents, ledgers, projections, packets, evidence]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
