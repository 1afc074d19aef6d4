"""All registered queries by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packlens.plans import answering, corpus, degradation, evaluation, learning, operations, retrieval

_MODULES = (degradation, retrieval, answering, corpus, evaluation, operations, learning)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: query for module in _MODULES for key, query in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {key: sql for module in _MODULES for key, sql in module.ORACLES.items()}
