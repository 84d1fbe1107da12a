"""Live forms of the log and alert operators; each gives the same rows as its batch form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from traceframe.operators import logs
from traceframe.operators.ordered import MICROS, context_before, join_one_per_key, number_chunk, number_rows, time_chunks, trailing_counts
from traceframe.sinks.streaming import Sink
from traceframe.streaming.carry import Carry


def deduplicated(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats that a reconnecting source delivers again, within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def live_exceptions(
    sink: Sink,
    carry: Carry,
    context: int = 50,
    extra: Sequence[logs.LinePattern] = (),
    key: str = "stream_id",
    order: str = "line_no",
    reach: int = 1000,
    trace_sink: Sink | None = None,
    restarts: bool = False,
):
    """``foreachBatch`` function: exception events with context for lines ``(stream_id, line_no, ts, line)``.

    Carried per stream: of a traceback still open its first line and others less than ``reach`` line numbers behind it (the
    ``stacktrace`` of its event holds these and the lines of the last batch), the last ``context - 1`` lines, and the counts so
    far. So what is carried is bounded, however long a trace stays open. With ``trace_sink`` every line of a trace goes there
    as it arrives, as ``(key, trace_start, line number, text)``, only the first line of an open trace is carried, and events
    have no ``stacktrace`` but the ``trace_start`` to join by: a trace's lines are those up to the event's line, and those
    of a trace that never closes meet no event. Lines of a stream must arrive in order from batch to batch; within a batch
    any order will do. ``restarts``: line numbers begin anew in each batch (as :func:`text_lines.place_lines` gives them) and
    are replaced by the number of the line in the stream.
    """
    held = 1 if trace_sink else reach

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lines = batch.where(F.trim("line") != "").select(key, order, "ts", "line")
        old = carry.before(spark, batch_id)
        fresh = number_rows(lines.withColumn("__chunk", number_chunk(F.col(order))), [key], "__chunk", [order], "__no").drop("__chunk")
        if old is None:
            numbered = fresh.withColumn("__new", F.lit(True)).withColumn("__found", F.lit(0).cast("long"))
        else:
            # one row per stream: how many lines and events came before this batch
            totals = old.groupBy(key).agg(F.max("__no").alias("__base"), F.max("__found").alias("__found"))
            placed = join_one_per_key(fresh, totals, [key], order).withColumn("__no", F.col("__no") + F.coalesce("__base", F.lit(0)))
            placed = placed.withColumn("__found", F.coalesce("__found", F.lit(0).cast("long"))).drop("__base")
            again = old.select(*[c for c in placed.columns], F.lit(False).alias("__new"))
            numbered = placed.withColumn("__new", F.lit(True)).unionByName(again)
        if restarts:
            # carried lines have theirs already, and it is the same
            numbered = numbered.withColumn(order, F.col("__no"))
        numbered = numbered.persist()
        try:
            detected = logs.detect_lines(numbered, extra)
            # carried lines were counted in their own batch
            detected = detected.withColumn("__hit", F.col("hit"))
            marked = logs.trace_lines(detected, key, order).persist()
            counted = F.when(F.col("__new") & F.col("hit").isNotNull() & ~F.col("is_file"), 1).otherwise(0)
            old_hits = F.when(~F.col("__new") & F.col("hit").isNotNull() & ~F.col("is_file"), 1).otherwise(0)
            repeats = marked.groupBy(key).agg(F.sum(old_hits).alias("__repeat"), F.max("__found").alias("__before"))
            events = logs.build_events(marked, key, order, None if trace_sink else reach)
            if trace_sink:
                trace_sink(marked.where(F.col("__new") & F.col("trace_begin").isNotNull()).select(key, F.col("trace_begin").alias("trace_start"), order, F.trim("line").alias("text")), batch_id)
            news = numbered.where("__new").select(key, order, F.col("__no").alias("__line"))
            placed_events = join_one_per_key(events.join(news, [key, order]), repeats, [key], order).withColumn(
                "total_exceptions_found", F.col("total_exceptions_found") - F.col("__repeat") + F.col("__before")
            ).drop("__repeat", "__before")
            stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            rendered = F.format_string("[%s] Line %d: %s", stamp, F.col("__no"), F.trim("line"))
            rows = numbered.select(key, F.col("__no").alias("__line"), rendered.alias("__text"))
            out = context_before(placed_events, rows, [key], "__line", F.col("__text"), context, "context_lines")
            sink(out.withColumnRenamed("__line", "line_number"), batch_id)

            ends = marked.groupBy(key).agg(F.max("__no").alias("__last"), (F.max("__found") + F.sum(counted)).alias("__total"))
            kept = join_one_per_key(marked, ends, [key], order).where((F.col("trace_open") & (F.col(order) - F.col("trace_begin") < held)) | (F.col("__no") > F.col("__last") - F.greatest(F.lit(context - 1), F.lit(1))))
            remembered = kept.select(key, order, "ts", "line", "__no", F.col("__total").alias("__found"))
            if old is not None:
                # streams silent in this batch are part of ``marked`` through their carried lines
                remembered = remembered.dropDuplicates([key, order])
            carry.save(remembered, batch_id)
            marked.unpersist()
        finally:
            numbered.unpersist()

    return run


def live_trailing_alerts(
    sink: Sink, carry: Carry, keys: Sequence[str], ts: str = "ts", seconds: int = 300, threshold: int = 3, delay_seconds: int = 600
):
    """``foreachBatch`` function: trailing-window alerts for new events.

    Carried: events younger than the window (plus ``delay_seconds`` for late ones) counted back from
    the latest time of their own key, so a key that lags behind others loses nothing. They are rows of a
    table, not one key's state. An event later than ``delay_seconds`` is counted with what is still
    carried; counts already sent are not sent again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        old = carry.before(batch.sparkSession, batch_id)
        fresh = batch.withColumn("__new", F.lit(True))
        merged = fresh if old is None else fresh.unionByName(old.withColumn("__new", F.lit(False)))
        merged = merged.persist()
        try:
            counted = trailing_counts(merged, keys, ts, seconds, "n_recent")
            sink(counted.where(F.col("__new") & (F.col("n_recent") >= threshold)).drop("__new"), batch_id)
            at = F.unix_micros(F.col(ts).cast("timestamp"))
            latest = merged.groupBy(*keys).agg(F.max(at).alias("__latest"))
            young = join_one_per_key(merged, latest, keys, ts).where(at > F.col("__latest") - (seconds + delay_seconds) * MICROS)
            carry.save(young.drop("__new", "__latest"), batch_id)
        finally:
            merged.unpersist()

    return run


def live_count_alerts(sink: Sink, carry: Carry, keys: Sequence[str], ts: str, tie: str, every: int):
    """``foreachBatch`` function: fires at every ``every``-th event of a key; carried is one count per key."""

    def run(batch: DataFrame, batch_id: int) -> None:
        old = carry.before(batch.sparkSession, batch_id)
        batch = batch.persist()
        try:
            placed = number_rows(time_chunks(batch, keys, ts), keys, "__chunk", [ts, tie], "n_event").drop("__chunk")
            counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
            if old is not None:
                placed = join_one_per_key(placed, old, keys, tie).withColumn("n_event", F.col("n_event") + F.coalesce("__n", F.lit(0))).drop("__n")
                counts = old.unionByName(counts).groupBy(*keys).agg(F.sum("__n").alias("__n"))
            sink(placed.where(F.col("n_event") % every == 0), batch_id)
            carry.save(counts, batch_id)
        finally:
            batch.unpersist()

    return run


def live_counters(stream: DataFrame, dimensions: Sequence[str], ts: str = "ts") -> DataFrame:
    """Running total and counts per dimension; run it in update or complete mode."""
    from traceframe.operators.checks import counts_with_last

    return counts_with_last(stream, dimensions, ts)


def windowed_counts(stream: DataFrame, keys: Sequence[str], ts: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Coarse live counts per key in tumbling or sliding windows of event time."""
    at = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    return stream.withWatermark(ts, delay).groupBy(at.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def live_filter(stream: DataFrame, predicates: Sequence[Column]) -> DataFrame:
    from traceframe.operators.checks import filter_all

    return filter_all(stream, predicates)


def start(stream: DataFrame, run: Sink, checkpoint: str, name: str | None = None, available_now: bool = False, every: str = "5 seconds", mode: str = "append") -> StreamingQuery:
    """Start a ``foreachBatch`` query; offsets live in ``checkpoint``, so a restart neither loses nor repeats."""
    writer = stream.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def run_bounded(query: StreamingQuery, seconds: float | None = None) -> dict:
    """Let a query run for ``seconds`` (or until it ends by itself), stop it, and summarize its progress."""
    try:
        query.awaitTermination(seconds) if seconds is not None else query.awaitTermination()
    finally:
        if query.isActive:
            query.stop()
    progress = query.recentProgress
    return {"batches": len(progress), "input_rows": sum(p["numInputRows"] for p in progress)}
