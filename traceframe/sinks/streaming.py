"""Sinks for micro-batches: fan-out, callbacks, logs, idempotent folders."""

from __future__ import annotations

import asyncio
import inspect
import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.sinks.files import export_ready, tail, text_report

log = logging.getLogger("traceframe.sinks")
Sink = Callable[[DataFrame, int], None]


def fan_out(sinks: Mapping[str, Sink], failures: dict[str, int] | None = None) -> Sink:
    """Send each micro-batch to every sink. A failing sink is logged (and counted) and the others still run.

    The batch is kept for the duration of the loop, so its source is computed once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(kept, batch_id)
                except Exception as error:  # noqa: BLE001 - sinks are independent
                    log.error("sink %s failed on batch %d: %s", name, batch_id, error)
                    if failures is not None:
                        failures[name] = failures.get(name, 0) + 1
        finally:
            kept.unpersist()

    return run


def filtered(sink: Sink, predicate) -> Sink:
    """A sink that sees only rows the Column predicate accepts."""
    return lambda batch, batch_id: sink(batch.where(predicate), batch_id)


def folder(path: str, fmt: str = "parquet") -> Sink:
    """One sub-folder per batch, overwritten when a batch is replayed: exactly once for readers."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite").format(fmt)
        if fmt == "json":
            writer = writer.option("ignoreNullFields", "false")
        writer.save(f"{path}/batch={batch_id}")

    return write


def json_lines(path: str) -> Sink:
    write = folder(path, "json")
    return lambda batch, batch_id: write(export_ready(batch), batch_id)


def text_blocks(path: str) -> Sink:
    return lambda batch, batch_id: text_report(batch).write.mode("overwrite").text(f"{path}/batch={batch_id}")


def callback(function: Callable[[dict], object]) -> Sink:
    """Call a user function (plain or async) per event, on the executors; its errors are logged and swallowed."""

    def partition(rows) -> None:
        for row in rows:
            try:
                answer = function(row.asDict(recursive=True))
                if inspect.isawaitable(answer):
                    asyncio.run(_await(answer))
            except Exception as error:  # noqa: BLE001 - user code must not end the stream
                logging.getLogger("traceframe.sinks").error("callback failed: %s", error)

    return lambda batch, batch_id: batch.foreachPartition(partition)


class Tally:
    """Calls that ended well and calls that failed, as the driver knows them after an action.

    Accumulators: a task that ran again after its executor was lost may count its calls again.
    """

    def __init__(self, spark: SparkSession):
        self._done, self._failed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @property
    def done(self) -> int:
        return self._done.value

    @property
    def failed(self) -> int:
        return self._failed.value


def counted_callback(function: Callable[[dict], object], tally: Tally) -> Sink:
    """:func:`callback` whose calls are counted: nothing but two numbers comes back from the executors."""
    done, failed = tally._done, tally._failed

    def counting(event: dict) -> object:
        try:
            answer = function(event)
            if inspect.isawaitable(answer):
                asyncio.run(_await(answer))
        except Exception:
            failed.add(1)
            raise
        done.add(1)
        return None

    return callback(counting)


async def _await(answer):
    return await answer


def console_lines(events: DataFrame, fields: Sequence[str] = ("ts", "exception_type", "message"), context: int = 5) -> DataFrame:
    """Printable text per event with its last ``context`` lines, in ``value``."""
    parts = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    block = F.array(*parts)
    if "context_lines" in events.columns and context:
        block = F.concat(block, F.transform(tail(F.coalesce("context_lines", F.array()), context), lambda c: F.concat(F.lit("  "), c)))
    return events.select(F.array_join(block, "\n").alias("value"))


def logger_sink(level: int = logging.ERROR, context: int = 5, fields: Sequence[str] = ("ts", "exception_type", "message")) -> Sink:
    """Write events to the executors' logs; nothing passes the driver."""

    def partition(rows) -> None:
        out = logging.getLogger("traceframe.events")
        for row in rows:
            out.log(level, "%s", row.value)

    return lambda batch, batch_id: console_lines(batch, fields, context).foreachPartition(partition)
