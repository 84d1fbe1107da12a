"""HTTP check records: failures, retries, filters, suggestions and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The status floor each severity name stands for; any other name means the first.
SEVERITY_FLOOR = {"low": 400, "medium": 500, "high": 503}
BODY_CHARS = 1000


def failure_message(status: Column, reason: Column) -> Column:
    """``HTTP <code>: <reason>`` for a status of 400 or more, else null."""
    return F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), F.coalesce(reason, F.lit(""))))


def suggestion(message: Column, status: Column) -> Column:
    """Hint by failure kind: a timeout wins over the status."""
    return (
        F.when(F.lower(message).contains("timeout"), "increase timeout")
        .when(status >= 500, "server error")
        .when(status >= 400, "client error")
    )


def event_filter(
    types: Sequence[str] | None = None,
    url_patterns: Sequence[str] | None = None,
    min_severity: str | None = None,
    url: str = "url",
    kind: str = "exception_type",
    status: str = "response_status",
) -> Column:
    """Type in the list and URL matching any pattern and status at the severity floor; a missing or
    zero status passes the floor. Works on batch and streaming frames alike."""
    parts = [F.lit(True)]
    if types:
        parts.append(F.coalesce(F.col(kind).isin(*types), F.lit(False)))
    if url_patterns:
        parts.append(F.rlike(F.col(url), F.lit("|".join(f"(?:{p})" for p in url_patterns))))
    if min_severity:
        code = F.coalesce(F.col(status), F.lit(0))
        parts.append((code == 0) | (code >= SEVERITY_FLOOR.get(min_severity, 400)))
    return reduce(lambda a, b: a & b, parts)


def filter_all(events: DataFrame, predicates: Sequence[Column]) -> DataFrame:
    """Keep events that every user predicate accepts; an unknown answer counts as no."""
    return events.where(reduce(lambda a, b: a & b, predicates, F.lit(True)))


def filter_counted(events: DataFrame, predicates: Sequence[Column]) -> tuple[DataFrame, Observation]:
    """:func:`filter_all`, with the numbers of events before and after it counted beside the flow.

    The observation has ``total`` and ``kept`` once an action has read the frame; it costs no pass of its own. A task that
    runs again is counted once.
    """
    seen = Observation()
    accepted = F.coalesce(reduce(lambda a, b: a & b, predicates, F.lit(True)), F.lit(False))
    return filter_all(events.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(accepted).alias("kept")), predicates), seen


def collapse_retries(attempts: DataFrame, keys: Sequence[str] = ("check_id",)) -> DataFrame:
    """One row per check: last attempt's outcome, attempts used, total back-off seconds, failure flag.

    The last attempt is kept by a mergeable aggregate, so attempts combine before the shuffle.
    """
    outcome = F.struct("url", "ts", "status", "error_type", "error", "body")
    failed = F.col("last.error_type").isNotNull() | (F.coalesce(F.col("last.status"), F.lit(0)) >= 400)
    grouped = attempts.groupBy(*keys).agg(
        F.max_by(outcome, F.col("attempt")).alias("last"),
        F.count(F.lit(1)).alias("attempts"),
        # the wait after attempt i is 2^i seconds, and none follows the last one
        (F.sum(F.pow(F.lit(2.0), F.col("attempt"))) - F.pow(F.lit(2.0), F.max("attempt"))).cast("long").alias("backoff_seconds"),
    )
    return grouped.select(
        *keys,
        F.col("last.url").alias("url"),
        F.col("last.ts").alias("ts"),
        "attempts",
        "backoff_seconds",
        F.col("last.status").alias("response_status"),
        F.col("last.error").alias("exception"),
        F.col("last.error_type").alias("exception_type"),
        F.col("last.body").alias("response_body"),
        failed.alias("failed"),
    )


def attempt_lines(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """The text lines a check writes per attempt, as ``(url, ts, __seq, line)`` rows for the context ring."""
    failed = F.col("error_type").isNotNull()
    answered = F.col("status").isNotNull()
    code = F.col("status").cast("string")
    lines = F.array(
        F.concat(F.lit("Attempt "), (F.col("attempt") + 1).cast("string"), F.lit(f"/{max_retries + 1} for GET "), F.col("url")),
        F.when(answered, F.concat(F.lit("Response: "), code, F.lit(" from "), F.col("url"))),
        F.when(answered & failed, F.concat(F.lit("Error response: HTTP "), code, F.lit(": "), F.col("error"))),
        F.when(failed, F.concat(F.lit("Request failed: "), F.col("error_type"), F.lit(" - "), F.col("error"))),
        F.when(
            failed & (F.col("attempt") < max_retries),
            F.concat(F.lit("Retrying in "), F.pow(F.lit(2.0), F.col("attempt")).cast("long").cast("string"), F.lit(" seconds...")),
        ),
    )
    kept = F.filter(lines, lambda x: x.isNotNull())
    return attempts.select("check_id", "attempt", "event_id", "url", "ts", F.posexplode(kept).alias("__at", "line"))


def counts_with_last(events: DataFrame, dimensions: Sequence[str], ts: str = "ts") -> DataFrame:
    """Total, and counts by each dimension, with the latest event time, in one pass."""
    pairs = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")),
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions],
    )
    return (
        events.select(ts, F.explode(pairs).alias("p"))
        .groupBy("p.dimension", "p.value")
        .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"))
    )


def latest_per_url(failures: DataFrame, tie: str, ts: str = "ts") -> DataFrame:
    """Per URL: count and the latest event; ``tie`` orders events of the same time."""
    latest = F.max_by(F.struct("exception_type", ts, "exception"), F.struct(ts, tie))
    return (
        failures.groupBy("url")
        .agg(F.count(F.lit(1)).alias("n"), latest.alias("latest"))
        .select(
            "url",
            "n",
            F.col("latest.exception_type").alias("latest_type"),
            F.col(f"latest.{ts}").alias("latest_ts"),
            F.col("latest.exception").alias("latest_message"),
        )
    )
