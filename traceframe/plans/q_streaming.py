"""Streaming queries. The tables are replayed in two or three slices that arrive one after the other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.operators import checks, logs
from traceframe.plans import views
from traceframe.plans.q_checks import failures
from traceframe.plans.q_logs import TRACES
from traceframe.plans.registry import query
from traceframe.plans.views import table
from traceframe.session import scratch_folder as scratch
from traceframe.sinks import streaming as sinks
from traceframe.sources import records, text_lines
from traceframe.streaming import live
from traceframe.streaming.carry import Carry


@dataclass
class Replay:
    """Folder of a replayed stream, and the slices that are still to arrive."""

    folder: str
    coming: list[DataFrame]

    def __str__(self) -> str:
        return self.folder


def replay(spark, df, order: str, slices: int = 3):
    """All rows of ``df`` as a stream in ``slices`` steps of ``order``; returns (stream, its ``Replay``).

    All tasks write a slice. ``finish`` lets one arrive, runs the stream on its checkpoint until nothing is left, and goes on with
    the next one, so every slice also tests a restart. Rows without an order arrive first.
    """
    root = scratch(spark)
    low, high = df.agg(F.min(order), F.max(order)).first()
    low, high = (0, 0) if low is None else (low, high)
    step = (high - low) // slices + 1
    at = F.coalesce(F.floor((F.col(order) - low) / step), F.lit(0))
    parts = [df.where(at == i) for i in range(slices)]
    parts[0].write.parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).parquet(f"{root}/in"), Replay(root, parts[1:])


def events_stream(spark, sf, slices=3):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return replay(spark, events, "event_id", slices)


def failure_stream(spark, sf, slices=2):
    return replay(spark, failures(spark, sf), "event_id", slices)


def finish(spark, stream, run, root, mode="append"):
    live.run_bounded(live.start(stream, run, f"{root}/checkpoint", available_now=True, mode=mode))
    for part in root.coming:
        part.write.mode("append").parquet(f"{root}/in")
        live.run_bounded(live.start(stream, run, f"{root}/checkpoint", available_now=True, mode=mode))
    return spark.read.parquet(f"{root}/out")


def as_lines(stream):
    text = views._dialect(views.VIEWS["v_lines"], views.SPARK)
    return stream.sparkSession.sql(text, events=stream)


@query(
    "r01_live_exceptions",
    f"""WITH {TRACES}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS no FROM v_lines)
    SELECT e.stream_id, e.line_no, e.pattern, e.exception_type, e.message, e.severity, e.app_name, e.stack, n.no AS line_number, least(n.no, 20) AS n_context
    FROM events e JOIN n ON e.stream_id = n.stream_id AND e.line_no = n.line_no""",
    ["v_lines"],
)
def r01(spark, sf):
    stream, root = events_stream(spark, sf, 2)
    run = live.live_exceptions(sinks.folder(f"{root}/out"), Carry(f"{root}/carry"), context=20)
    out = finish(spark, as_lines(stream), run, root)
    return out.select(
        "stream_id", "line_no", "pattern", "exception_type", "message", "severity", F.col("app.app_name").alias("app_name"),
        F.array_join("stacktrace", "\n").alias("stack"), "line_number", F.size("context_lines").cast("long").alias("n_context"),
    )


@query(
    "r01_live_files",
    f"""WITH {TRACES}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS no FROM v_lines)
    SELECT CAST(e.stream_id AS VARCHAR) AS stream_id, n.no AS line_no, e.ts, e.pattern, e.exception_type, e.message, e.severity, e.app_name,
      CASE WHEN e.severity = 'ERROR' THEN e.stack_lines ELSE 0 END AS stack_lines
    FROM events e JOIN n ON e.stream_id = n.stream_id AND e.line_no = n.line_no WHERE e.pattern <> 'python_traceback_start'""",
    ["v_lines"],
)
def r01_files(spark, sf):
    """Log files arrive folder by folder: numbered, dated and detected as they come; trace lines are written beside the events."""
    lines, root = as_lines(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))), scratch(spark)
    low, high = lines.agg(F.min("line_no"), F.max("line_no")).first()
    text = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "line")
    logged = text_lines.stream_lines(spark, f"{root}/in/*/*")
    events, traces = sinks.folder(f"{root}/out"), sinks.folder(f"{root}/traces")
    detect = live.live_exceptions(events, Carry(f"{root}/carry"), context=1, trace_sink=traces, restarts=True)
    for at in range(3):
        a, b = (low or 0) + at * (((high or 0) - (low or 0)) // 3 + 1), (low or 0) + (at + 1) * (((high or 0) - (low or 0)) // 3 + 1)
        # ranges of a stream become files whose names sort as their lines do
        part = lines.where((F.col("line_no") >= a) & (F.col("line_no") < b)).repartitionByRange(4, "stream_id", "line_no").sortWithinPartitions("stream_id", "line_no")
        part.select(F.lit(at).alias("slice"), "stream_id", text.alias("value")).write.mode("append").partitionBy("slice", "stream_id").text(f"{root}/in")
        live.run_bounded(live.start(logged, lambda batch, i: detect(text_lines.place_lines(batch), i), f"{root}/checkpoint", available_now=True))
    found = spark.read.parquet(f"{root}/out").where("pattern <> 'python_traceback_start'")
    kept = spark.read.parquet(f"{root}/traces").select(F.col("stream_id").alias("s"), F.col("trace_start").alias("t"), F.col("line_no").alias("n"))
    ends = found.where("trace_start is not null").select("stream_id", "line_no", "trace_start")
    met = kept.join(ends, (F.col("s") == F.col("stream_id")) & (F.col("t") == F.col("trace_start"))).where("n <= line_no")
    sizes = met.groupBy("stream_id", "line_no").agg(F.count(F.lit(1)).alias("stack_lines"))
    out = found.join(sizes, ["stream_id", "line_no"], "left")
    return out.select(
        "stream_id", "line_no", F.col("ts").cast("timestamp_ntz").alias("ts"), "pattern", "exception_type", "message", "severity", F.col("app.app_name").alias("app_name"),
        F.coalesce("stack_lines", F.lit(0)).cast("long").alias("stack_lines"),
    )


@query(
    "r02_live_trailing_alert",
    """SELECT user_id, event_id, n_recent FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
      RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n_recent FROM events WHERE event_type = 'error') WHERE n_recent >= 3""",
)
def r02(spark, sf):
    stream, root = events_stream(spark, sf)
    errors = stream.where(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    run = live.live_trailing_alerts(sinks.folder(f"{root}/out"), Carry(f"{root}/carry"), ["user_id"], "ts", 86_400, 3)
    return finish(spark, errors, run, root).select("user_id", "event_id", "n_recent")


@query(
    "r03_live_counters",
    """SELECT 'total' AS dimension, '' AS value, COUNT(*) AS n FROM v_failures UNION ALL SELECT 'url', url, COUNT(*) FROM v_failures GROUP BY 2
    UNION ALL SELECT 'exception_type', exception_type, COUNT(*) FROM v_failures GROUP BY 2""",
    ["v_failures"],
)
def r03(spark, sf):
    stream, root = failure_stream(spark, sf)
    counters = live.live_counters(stream, ["url", "exception_type"])
    # complete mode rewrites the whole (small) dashboard each time; the newest folder is the answer
    out = finish(spark, counters, sinks.folder(f"{root}/out"), root, mode="complete")
    newest = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == newest).select("dimension", "value", "n")


@query(
    "r04_live_count_alert",
    """SELECT url, event_id, n_event FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS n_event FROM v_failures) WHERE n_event % 3 = 0""",
    ["v_failures"],
)
def r04(spark, sf):
    stream, root = failure_stream(spark, sf, 3)
    run = live.live_count_alerts(sinks.folder(f"{root}/out"), Carry(f"{root}/carry"), ["url"], "ts", "event_id", 3)
    return finish(spark, stream, run, root).select("url", "event_id", "n_event")


@query("r05_bounded_run", "SELECT COUNT(*) AS input_rows FROM v_failures", ["v_failures"])
def r05(spark, sf):
    stream, root = failure_stream(spark, sf)
    out = finish(spark, stream, sinks.folder(f"{root}/out"), root)
    return out.agg(F.count(F.lit(1)).alias("input_rows"))


@query(
    "r06_live_filter",
    """SELECT event_id, url FROM v_failures WHERE (coalesce(response_status, 0) = 0 OR response_status >= 500) AND regexp_matches(url, 'svc[0-4]')""",
    ["v_failures"],
)
def r06(spark, sf):
    stream, root = failure_stream(spark, sf)
    wanted = live.live_filter(stream, [checks.event_filter(url_patterns=["svc[0-4]"], min_severity="medium")])

    def broken(batch, batch_id):
        raise RuntimeError("a failing sink must not stop the others")

    run = sinks.fan_out({"broken": broken, "files": sinks.folder(f"{root}/out")})
    return finish(spark, wanted, run, root).select("event_id", "url")


@query("r07_no_repeats", "SELECT event_id, url FROM v_failures", ["v_failures"])
def r07(spark, sf):
    stream, root = failure_stream(spark, sf)
    # every row arrives twice, as after a reconnect that starts again too early
    twice = stream.unionByName(stream)
    clean = live.deduplicated(twice, ["event_id"], "ts", "40 days")
    return finish(spark, clean, sinks.folder(f"{root}/out"), root).select("event_id", "url")


@query(
    "r08_windowed_counts",
    "SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2",
)
def r08(spark, sf):
    stream, root = events_stream(spark, sf, 2)
    counted = live.windowed_counts(stream, ["event_type"], "ts", "1 day")
    out = finish(spark, counted, sinks.folder(f"{root}/out"), root, mode="complete")
    newest = out.agg(F.max("batch")).first()[0]
    latest = out.where(F.col("batch") == newest)
    return latest.select(F.unix_micros("window.start").alias("day_us"), "event_type", "n")


@query(
    "k01_trimmed_export",
    """WITH n AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS line_no, ts, line FROM v_lines),
    c AS (SELECT *, string_agg('[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '] Line ' || line_no || ': ' || trim(line), chr(10))
      OVER (PARTITION BY stream_id ORDER BY line_no ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS context FROM n)
    SELECT stream_id, line_no, context FROM c WHERE line LIKE 'KeyError%'""",
    ["v_lines"],
)
def k01(spark, sf):
    from traceframe.plans.q_logs import lines
    from traceframe.sinks.files import export_ready

    numbered = logs.number_lines(lines(spark, sf))
    hits = numbered.where(F.col("line").startswith("KeyError"))
    exported = export_ready(logs.with_context(hits, numbered, 50), keep=15)
    return exported.select("stream_id", "line_no", F.array_join("context_lines", "\n").alias("context"))


def _refuse_timeouts(event: dict) -> None:
    if event["exception_type"] == "ConnectTimeout":
        raise ValueError(event["url"])


@query(
    "k08_callback",
    "SELECT count_if(exception_type <> 'ConnectTimeout') AS done, count_if(exception_type = 'ConnectTimeout') AS failed FROM v_failures",
    ["v_failures"],
)
def k08(spark, sf):
    """A user function is called for every failure on the executors; its calls are counted, its errors end nothing."""
    tally = sinks.Tally(spark)
    sinks.counted_callback(_refuse_timeouts, tally)(failures(spark, sf), 0)
    return spark.range(1).select(F.lit(tally.done).cast("long").alias("done"), F.lit(tally.failed).cast("long").alias("failed"))


@query(
    "k06_console_lines",
    """SELECT 'url: ' || url || chr(10) || 'exception_type: ' || exception_type || chr(10) || '  ' || body AS value FROM v_failures""",
    ["v_failures"],
)
def k06(spark, sf):
    rows = failures(spark, sf).withColumn("context_lines", F.array("body"))
    return sinks.console_lines(rows, ["url", "exception_type"], 5)


@query(
    "s08_sampled_schema",
    "SELECT conv_id, turn, role, length(text) AS chars FROM conversations",
)
def s08(spark, sf):
    root = scratch(spark)
    table(spark, sf, "conversations").write.json(f"{root}/json")
    shape = records.sampled_schema(spark, f"{root}/json")
    return spark.read.schema(shape).json(f"{root}/json").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query(
    "h04_item_generator",
    "SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations",
)
def h04(spark, sf):
    def lines_of(item):
        for line in item["text"].split("\n"):
            yield {"conv_id": item["conv_id"], "turn": item["turn"], "line": line}

    return records.per_item(table(spark, sf, "conversations"), lines_of, "conv_id bigint, turn bigint, line string")


@query(
    "h04_item_table",
    """SELECT conv_id, turn, CAST(w.at AS INTEGER) AS at, w.line AS line FROM conversations,
    LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at) w""",
)
def h04_table(spark, sf):
    def lines_of(item):
        for at, line in enumerate(item["text"].split("\n"), 1):
            yield {"at": at, "line": line}

    items = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return records.with_generated(items, lines_of, "at int, line string").drop("text")


@query(
    "s09_file_scan",
    """SELECT lang, source, COUNT(*) AS docs, CAST(SUM(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY 1, 2""",
)
def s09(spark, sf):
    from traceframe.sources.code_files import scan_files

    root = scratch(spark)
    docs = table(spark, sf, "documents").select("lang", "source", F.concat("text", F.lit("\n\u0001")).alias("value"))
    docs.write.option("maxRecordsPerFile", 200).partitionBy("lang", "source").text(f"{root}/files")
    files = scan_files(spark, f"{root}/files", "*.txt")
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]*)/", 1).alias(name)
    return files.groupBy(part("lang"), part("source")).agg(
        F.sum(F.length(F.regexp_replace("text", "[^\u0001]", ""))).alias("docs"),
        # every document ends in one more line break, the mark and the break of its row
        F.sum(F.length(F.regexp_replace("text", "[^\n]", "")) - F.length(F.regexp_replace("text", "[^\u0001]", ""))).alias("lines"),
    )


@query("k07_fan_out", "SELECT url, event_id, exception_type FROM v_failures", ["v_failures"])
def k07(spark, sf):
    root = scratch(spark)

    def broken(batch, batch_id):
        raise RuntimeError("a failing sink must not stop the others")

    rows = failures(spark, sf).select("url", "event_id", "exception_type")
    sinks.fan_out({"first": sinks.folder(f"{root}/a"), "broken": broken, "last": sinks.folder(f"{root}/b")})(rows, 0)
    return spark.read.parquet(f"{root}/b").select("url", "event_id", "exception_type")


@query("h01_user_predicates", "SELECT event_id FROM v_failures WHERE response_status = 404 AND url LIKE '%svc1%'", ["v_failures"])
def h01(spark, sf):
    mine = [lambda df: df.where(F.col("response_status") == 404), lambda df: df.where(F.col("url").contains("svc1"))]
    out = failures(spark, sf)
    for step in mine:
        out = out.transform(step)
    return out.select("event_id")


@query("h02_user_sink", "SELECT url, COUNT(*) AS n FROM v_failures GROUP BY 1", ["v_failures"])
def h02(spark, sf):
    stream, root = failure_stream(spark, sf)

    def mine(batch, batch_id):
        counted = batch.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    return finish(spark, stream, mine, root).groupBy("url").agg(F.sum("n").alias("n"))


@query(
    "h03_user_patterns",
    r"""SELECT stream_id, line_no, CASE WHEN line LIKE 'INFO click%' THEN 'python_click' ELSE 'python_view' END AS pattern, regexp_extract(line, '(\d+)$', 1) AS message
    FROM v_lines WHERE line LIKE 'INFO click%' OR line LIKE 'INFO view%'""",
    ["v_lines"],
)
def h03(spark, sf):
    from traceframe.plans.q_logs import lines

    mine = [
        logs.LinePattern.named("python_click", r"^INFO (?P<exception_type>click) user (?P<message>\d+)$", ignore_case=False),
        logs.LinePattern.named("python_view", r"^INFO (?P<exception_type>view) user (?P<message>\d+)$", ignore_case=False),
    ]
    found = logs.detect_lines(lines(spark, sf), mine).where(F.col("hit.pattern").isin("python_click", "python_view"))
    return found.select("stream_id", "line_no", "hit.pattern", "hit.message")


@query(
    "h05_user_checks",
    """SELECT path AS file, 'size' AS check_type, p_size <= 20 AS success, CASE WHEN p_size > 20 THEN 'LIMIT is ' || p_size ELSE '' END AS errors FROM v_source WHERE p_size % 2 = 0""",
    ["v_source"],
)
def h05(spark, sf):
    import re

    from traceframe.operators import validate
    from traceframe.session import spread

    def size(path, text):
        limit = int(re.search(r"LIMIT = (\d+)", text).group(1))
        if limit % 2:
            return None
        return validate.outcome(limit <= 20, errors=[] if limit <= 20 else [f"LIMIT is {limit}"])

    results = validate.run_checks(spread(views.view(spark, sf, "v_source")), {"size": size})
    return results.select("file", "check_type", "success", F.array_join("errors", ",").alias("errors"))
