"""Alerts and running state per key, built on chunked ordered scans (no key in one task)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.operators.ordered import last_rows, number_rows, ordered_scan, time_chunks, trailing_counts


def trailing_alerts(
    events: DataFrame, keys: Sequence[str], ts: str = "ts", seconds: int = 300, threshold: int = 3
) -> DataFrame:
    """Every event whose key has at least ``threshold`` events in ``(ts - seconds, ts]``, with that count."""
    return trailing_counts(events, keys, ts, seconds, "n_recent").where(F.col("n_recent") >= threshold)


def numbered(events: DataFrame, keys: Sequence[str], ts: str, tie: str, name: str = "n_event") -> DataFrame:
    """1-based place of each event in its key by ``(ts, tie)``; ``tie`` must be unique."""
    chunked = time_chunks(events, keys, ts)
    return number_rows(chunked, keys, "__chunk", [ts, tie], name).drop("__chunk")


def count_reset_alerts(events: DataFrame, keys: Sequence[str], ts: str, tie: str, every: int) -> DataFrame:
    """Fires at each ``every``-th event of a key; counting starts anew after it."""
    return numbered(events, keys, ts, tie).where(F.col("n_event") % every == 0)


def health_status(count: Column, threshold: int) -> Column:
    return (
        F.when(count >= 2 * threshold, "critical")
        .when(count >= threshold, "degraded")
        .when(count >= threshold // 2, "warning")
        .otherwise("ok")
    )


def health(events: DataFrame, keys: Sequence[str], ts: str, tie: str, threshold: int = 3) -> DataFrame:
    """Running error count per key and the health it stands for."""
    return numbered(events, keys, ts, tie).withColumn("health", health_status(F.col("n_event"), threshold))


def last_errors(
    events: DataFrame, keys: Sequence[str], ts: str, tie: str, fields: Sequence[str], n: int = 10
) -> DataFrame:
    """The last ``n`` events of the key up to and including each event, as an array of structs."""
    placed = numbered(events, keys, ts, tie)
    return last_rows(placed, keys, "n_event", F.struct(*fields), n, "last_errors")


def running_totals(
    events: DataFrame, keys: Sequence[str], ts: str, tie: str, totals: Mapping[str, Column]
) -> DataFrame:
    """Cumulative sums per key by ``(ts, tie)``."""
    chunked = time_chunks(events, keys, ts)
    return ordered_scan(chunked, keys, "__chunk", [ts, tie], sums=totals).drop("__chunk")
