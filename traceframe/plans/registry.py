"""Query registry: every query is a library call on the given tables plus, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from traceframe.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None, views: Sequence[str] = ()):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = with_views(oracle, views)
        return fn

    return add
