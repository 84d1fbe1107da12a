"""Batch sinks: JSON array, JSON Lines, text, day partitions, per-URL export, DOT text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.operators.ordered import join_one_per_key
from traceframe.session import cut_lineage, discard


def tail(array: Column, n: int) -> Column:
    """Last ``n`` entries of an array, all of them when it is shorter."""
    return F.slice(array, F.greatest(F.size(array) - (n - 1), F.lit(1)), n)


def iso(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def export_ready(events: DataFrame, ts: str = "ts", context: str = "context_lines", keep: int | None = None) -> DataFrame:
    """ISO time text; with ``keep`` only the last context lines."""
    out = events.withColumn(ts, iso(F.col(ts)))
    return out.withColumn(context, tail(F.col(context), keep)) if keep is not None and context in events.columns else out


def json_rows(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text per event in a column ``value``."""
    return events.select(F.to_json(F.struct(*(columns or events.columns))).alias("value"))


def write_json_lines(events: DataFrame, path: str, mode: str = "append", keep: int | None = None) -> None:
    """One event per line, written by all tasks in parallel; null fields are kept, and all context lines without ``keep``."""
    export_ready(events, keep=keep).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json_array(events: DataFrame, path: str, order: list[str], limit: int | None = None, keep: int | None = 15) -> int:
    """A JSON array of all events in ``order``, written by all tasks; returns the number of events.

    The part files, one after the other in the order of their names, are one array, an event a line; few events are one file.
    The events are written once with their place, so the place decides which line opens and which closes the array, whatever
    the parts. ``keep`` is the number of context lines (None: all); with ``limit`` more events than that are refused, never cut.
    """
    ready = export_ready(events, keep=keep)
    text = F.to_json(F.struct(*ready.columns))
    placed = cut_lineage(ready.orderBy(*order).select(text.alias("value"), F.monotonically_increasing_id().alias("at")))
    total, first, last = placed.agg(F.count(F.lit(1)), F.min("at"), F.max("at")).first()
    if limit is not None and total > limit:
        discard(placed)
        raise ValueError(f"{total} events exceed the limit of {limit} for one array")
    if not total:
        lines = events.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)
    else:
        opened, closed = F.when(F.col("at") == first, "[").otherwise(""), F.when(F.col("at") == last, "]").otherwise(",")
        lines = placed.repartitionByRange("at").sortWithinPartitions("at").select(F.concat(opened, "value", closed).alias("value"))
    lines.write.mode("overwrite").text(path)
    discard(placed)
    return total


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of an array that :func:`write_json_array` wrote, in no order."""
    body = F.regexp_replace(F.regexp_replace("value", r"^\[", ""), r"[,\]]$", "")
    rows = spark.read.text(path).select(body.alias("value")).where("value <> ''")
    return rows.select(F.from_json("value", schema).alias("e")).select("e.*")


def text_report(failures: DataFrame, ts: str = "ts") -> DataFrame:
    """Readable block per failure in ``value``: header, exception, status if any, last 3 context lines."""
    context = tail(F.col("context_lines"), 3)
    lines = F.array_compact(
        F.concat(
            F.array(
                F.concat(F.lit("["), iso(F.col(ts)), F.lit("] "), F.col("url")),
                F.concat(F.lit("  Exception: "), F.col("exception_type"), F.lit(" - "), F.col("exception")),
                F.when(
                    F.coalesce(F.col("response_status"), F.lit(0)) != 0,
                    F.concat(F.lit("  Response Status: "), F.col("response_status").cast("string")),
                ),
                F.when(F.size("context_lines") > 0, F.lit("  Context:")),
            ),
            F.transform(context, lambda c: F.concat(F.lit("    "), c)),
            F.array(F.lit("")),
        )
    )
    return failures.select(F.array_join(lines, "\n").alias("value"))


def write_text_report(failures: DataFrame, path: str, mode: str = "append") -> None:
    text_report(failures).write.mode(mode).text(path)


def with_day(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn("day", F.date_format(F.col(ts).cast("timestamp"), "yyyyMMdd"))


def write_by_day(events: DataFrame, path: str, ts: str = "ts", keep: int | None = None) -> None:
    """Append JSON lines (with ``keep`` that many last context lines) under ``day=yyyyMMdd`` folders; no shuffle, so a
    busy day is spread over tasks."""
    export_ready(with_day(events, ts), ts, keep=keep).write.mode("append").partitionBy("day").json(path)


def per_url_totals(events: DataFrame, url: str = "url") -> DataFrame:
    """Events per URL and the grand total in the row whose URL is null."""
    return events.rollup(url).agg(F.count(F.lit(1)).alias("n"))


def write_per_url(events: DataFrame, path: str, url: str = "url", rows_per_file: int = 1_000_000) -> DataFrame:
    """``{url: events}`` as one folder of JSON lines per URL; returns the totals.

    Rows of a URL are counted first and spread over one task for each ``rows_per_file`` of them, so neither a busy URL
    nor many small ones decide the size of a file.
    """
    counts = events.groupBy(url).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("__parts"))
    whole = F.xxhash64(*events.columns)
    sized = join_one_per_key(events.withColumn("__row", whole), counts, [url], "__row")
    spread = sized.withColumn("__folder", F.col(url)).repartition(F.col(url), F.pmod("__row", F.greatest("__parts", F.lit(1))))
    spread.drop("__row", "__parts").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("__folder").json(path)
    return per_url_totals(events, url)
