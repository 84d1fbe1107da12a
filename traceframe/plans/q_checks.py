"""Check, alert and sink queries over the HTTP check view and the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.operators import alerts, checks, logs
from traceframe.operators.ordered import number_rows, time_chunks
from traceframe.plans.registry import query
from traceframe.plans.views import table, view
from traceframe.session import cut_lineage, scratch_folder
from traceframe.sinks import files


def failures(spark, sf):
    return view(spark, sf, "v_failures").withColumn("ts", F.col("ts").cast("timestamp"))


def attempts(spark, sf):
    return view(spark, sf, "v_checks").withColumn("ts", F.col("ts").cast("timestamp"))


def errors(spark, sf):
    events = table(spark, sf, "events").where(F.col("event_type") == "error")
    return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")


def micros(ts="ts"):
    return F.unix_micros(F.col(ts))


@query(
    "s05_check_records",
    """SELECT event_id, url, epoch_us(ts) AS ts_us, error AS exception, error_type AS exception_type, status AS response_status,
    substr(body, 1, 1000) AS response_body FROM v_checks WHERE error_type IS NOT NULL""",
    ["v_checks"],
)
def s05(spark, sf):
    from traceframe.sources.records import check_failures

    return check_failures(attempts(spark, sf)).select(
        "event_id", "url", micros().alias("ts_us"), "exception", "exception_type", "response_status", "response_body"
    )


@query(
    "f12_event_filter",
    """SELECT event_id FROM v_failures WHERE exception_type IN ('HTTPStatusError', 'ConnectTimeout')
    AND regexp_matches(url, 'svc[0-4]\\.|svc9') AND (coalesce(response_status, 0) = 0 OR response_status >= 500)""",
    ["v_failures"],
)
def f12(spark, sf):
    keep = checks.event_filter(["HTTPStatusError", "ConnectTimeout"], [r"svc[0-4]\.", "svc9"], "medium")
    return failures(spark, sf).where(keep).select("event_id")


@query(
    "f13_predicate_chain",
    """SELECT event_id, url FROM v_failures WHERE (response_status IS NULL OR response_status >= 500 OR lower(exception) LIKE '%timeout%')
    AND url LIKE '%feed=b1%'""",
    ["v_failures"],
)
def f13(spark, sf):
    serious = (
        F.col("response_status").isNull()
        | (F.col("response_status") >= 500)
        | F.lower("exception").contains("timeout")
    )
    return checks.filter_all(failures(spark, sf), [serious, F.col("url").contains("feed=b1")]).select("event_id", "url")


@query(
    "f13_counted_chain",
    """SELECT COUNT(*) AS total, count_if((response_status IS NULL OR response_status >= 500 OR lower(exception) LIKE '%timeout%') AND url LIKE '%feed=b1%') AS kept,
    count_if((response_status IS NULL OR response_status >= 500 OR lower(exception) LIKE '%timeout%') AND url LIKE '%feed=b1%') AS written FROM v_failures""",
    ["v_failures"],
)
def f13_counted(spark, sf):
    serious = F.col("response_status").isNull() | (F.col("response_status") >= 500) | F.lower("exception").contains("timeout")
    kept, seen = checks.filter_counted(failures(spark, sf), [serious, F.col("url").contains("feed=b1")])
    written = cut_lineage(kept.select("event_id", "url"))
    counts = seen.get
    return written.agg(F.count(F.lit(1)).alias("written")).select(F.lit(counts["total"]).cast("long").alias("total"), F.lit(counts["kept"]).cast("long").alias("kept"), "written")


@query(
    "f14_failure_status",
    """SELECT event_id, 'HTTP ' || status || ': ' || coalesce(error, '') AS failure FROM v_checks WHERE status >= 400""",
    ["v_checks"],
)
def f14(spark, sf):
    rows = attempts(spark, sf).withColumn("failure", checks.failure_message(F.col("status"), F.col("error")))
    return rows.where(F.col("failure").isNotNull()).select("event_id", "failure")


@query(
    "f15_suggestion",
    """SELECT event_id, CASE WHEN lower(exception) LIKE '%timeout%' THEN 'increase timeout' WHEN response_status >= 500 THEN 'server error'
    WHEN response_status >= 400 THEN 'client error' END AS hint FROM v_failures""",
    ["v_failures"],
)
def f15(spark, sf):
    return failures(spark, sf).select(
        "event_id", checks.suggestion(F.col("exception"), F.col("response_status")).alias("hint")
    )


@query(
    "a02_totals",
    """SELECT 'total' AS dimension, '' AS value, COUNT(*) AS n, epoch_us(max(ts)) AS last_us FROM v_failures UNION ALL
    SELECT 'url', url, COUNT(*), epoch_us(max(ts)) FROM v_failures GROUP BY 2 UNION ALL
    SELECT 'exception_type', exception_type, COUNT(*), epoch_us(max(ts)) FROM v_failures GROUP BY 2""",
    ["v_failures"],
)
def a02(spark, sf):
    counted = checks.counts_with_last(failures(spark, sf), ["url", "exception_type"])
    return counted.select("dimension", "value", "n", micros("last_ts").alias("last_us"))


@query(
    "a04_latest_per_url",
    """SELECT url, COUNT(*) AS n, arg_max(exception_type, (ts, event_id)) AS latest_type, epoch_us(max(ts)) AS latest_us,
    arg_max(exception, (ts, event_id)) AS latest_message FROM v_failures GROUP BY 1""",
    ["v_failures"],
)
def a04(spark, sf):
    latest = checks.latest_per_url(failures(spark, sf), "event_id")
    return latest.select("url", "n", "latest_type", micros("latest_ts").alias("latest_us"), "latest_message")


@query(
    "a05_retry_collapse",
    """SELECT check_id, arg_max(url, attempt) AS url, COUNT(*) AS attempts,
    CAST(SUM(pow(2, attempt)) - pow(2, max(attempt)) AS BIGINT) AS backoff_seconds,
    last(status ORDER BY attempt) AS response_status, last(error_type ORDER BY attempt) AS exception_type,
    last(error_type ORDER BY attempt) IS NOT NULL OR coalesce(last(status ORDER BY attempt), 0) >= 400 AS failed
    FROM v_checks GROUP BY 1""",
    ["v_checks"],
)
def a05(spark, sf):
    return checks.collapse_retries(attempts(spark, sf)).select(
        "check_id", "url", "attempts", "backoff_seconds", "response_status", "exception_type", "failed"
    )


@query(
    "w01_check_context",
    """WITH l AS (SELECT event_id, attempt, url, ts, unnest([1,2,3,4,5]) AS k, status, error_type, error FROM v_checks),
    t AS (SELECT *, CASE k WHEN 1 THEN 'Attempt ' || (attempt + 1) || '/4 for GET ' || url
      WHEN 2 THEN CASE WHEN status IS NOT NULL THEN 'Response: ' || status || ' from ' || url END
      WHEN 3 THEN CASE WHEN status IS NOT NULL AND error_type IS NOT NULL THEN 'Error response: HTTP ' || status || ': ' || error END
      WHEN 4 THEN CASE WHEN error_type IS NOT NULL THEN 'Request failed: ' || error_type || ' - ' || error END
      ELSE CASE WHEN error_type IS NOT NULL AND attempt < 3 THEN 'Retrying in ' || CAST(pow(2, attempt) AS BIGINT) || ' seconds...' END END AS line FROM l),
    c AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY url ORDER BY ts, event_id, k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS context
      FROM t WHERE line IS NOT NULL)
    SELECT event_id, context FROM c WHERE k = 4 AND attempt = 3""",
    ["v_checks"],
)
def w01_checks(spark, sf):
    lines = checks.attempt_lines(attempts(spark, sf)).withColumn("seq", F.col("event_id") * 8 + F.col("__at"))
    numbered = number_rows(time_chunks(lines, ["url"], "ts"), ["url"], "__chunk", ["ts", "seq"], "line_no").drop("__chunk")
    final = numbered.where((F.col("attempt") == 3) & F.col("line").startswith("Request failed")).select(
        "url", "line_no", "event_id"
    )
    from traceframe.operators.ordered import context_before

    return context_before(final, numbered, ["url"], "line_no", F.col("line"), 10, "context_lines").select(
        "event_id", F.array_join("context_lines", "\n").alias("context")
    )


@query(
    "w02_trailing_alert",
    """SELECT user_id, event_id, epoch_us(ts) AS ts_us, n_recent FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
      RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n_recent FROM events WHERE event_type = 'error') WHERE n_recent >= 3""",
)
def w02(spark, sf):
    found = alerts.trailing_alerts(errors(spark, sf), ["user_id"], "ts", 86_400, 3)
    return found.select("user_id", "event_id", micros().alias("ts_us"), "n_recent")


@query(
    "w02_url_alert",
    """SELECT url, event_id, n_recent, exception_type, exception FROM (SELECT *, COUNT(*) OVER (PARTITION BY url ORDER BY epoch_us(ts)
      RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS n_recent FROM v_failures) WHERE n_recent >= 2""",
    ["v_failures"],
)
def w02_url(spark, sf):
    found = alerts.trailing_alerts(failures(spark, sf), ["url"], "ts", 300, 2)
    return found.select("url", "event_id", "n_recent", "exception_type", "exception")


@query(
    "w03_count_reset_alert",
    """SELECT url, event_id, n_event FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS n_event FROM v_failures)
    WHERE n_event % 3 = 0""",
    ["v_failures"],
)
def w03(spark, sf):
    return alerts.count_reset_alerts(failures(spark, sf), ["url"], "ts", "event_id", 3).select("url", "event_id", "n_event")


@query(
    "w04_health",
    """SELECT user_id, event_id, n_event, CASE WHEN n_event >= 10 THEN 'critical' WHEN n_event >= 5 THEN 'degraded' WHEN n_event >= 2 THEN 'warning'
    ELSE 'ok' END AS health FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n_event FROM events WHERE event_type = 'error')""",
)
def w04(spark, sf):
    return alerts.health(errors(spark, sf), ["user_id"], "ts", "event_id", 5).select("user_id", "event_id", "n_event", "health")


@query(
    "w05_last_errors",
    """SELECT url, event_id, string_agg(event_id || ':' || exception_type, ',') OVER (PARTITION BY url ORDER BY ts, event_id
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last_errors FROM v_failures""",
    ["v_failures"],
)
def w05(spark, sf):
    found = alerts.last_errors(failures(spark, sf), ["url"], "ts", "event_id", ["event_id", "exception_type"])
    text = F.transform("last_errors", lambda e: F.concat_ws(":", e["event_id"].cast("string"), e["exception_type"]))
    return found.select("url", "event_id", F.array_join(text, ",").alias("last_errors"))


@query(
    "w06_running_totals",
    """SELECT url, event_id, COUNT(*) OVER w AS n_so_far, CAST(SUM(coalesce(response_status, 0)) OVER w AS BIGINT) AS status_so_far
    FROM v_failures WINDOW w AS (PARTITION BY url ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    ["v_failures"],
)
def w06(spark, sf):
    sums = {"n_so_far": F.lit(1).cast("long"), "status_so_far": F.coalesce("response_status", F.lit(0)).cast("long")}
    found = alerts.running_totals(failures(spark, sf), ["url"], "ts", "event_id", sums)
    return found.select("url", "event_id", "n_so_far", "status_so_far")


@query(
    "k01_array_file",
    "SELECT event_id, url, exception, exception_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM v_failures",
    ["v_failures"],
)
def k01_array(spark, sf):
    """All failures as one JSON array in parallel parts, read back."""
    folder = scratch_folder(spark)
    files.write_json_array(failures(spark, sf), folder, ["ts", "event_id"])
    return files.read_json_array(spark, folder, "event_id long, url string, exception string, exception_type string, ts string")


@query(
    "k02_json_lines",
    """SELECT event_id, CAST(to_json({url: url, ts: strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), exception: exception, exception_type: exception_type,
    event_id: event_id}) AS VARCHAR) AS value FROM v_failures""",
    ["v_failures"],
)
def k02(spark, sf):
    ready = files.export_ready(failures(spark, sf))
    fields = F.struct("url", "ts", "exception", "exception_type", "event_id")
    return ready.select("event_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


@query(
    "k03_text_report",
    """SELECT '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '] ' || url || chr(10) || '  Exception: ' || exception_type || ' - ' || exception
    || CASE WHEN coalesce(response_status, 0) <> 0 THEN chr(10) || '  Response Status: ' || response_status ELSE '' END
    || chr(10) || '  Context:' || chr(10) || '    ' || body || chr(10) AS value FROM v_failures""",
    ["v_failures"],
)
def k03(spark, sf):
    return files.text_report(failures(spark, sf).withColumn("context_lines", F.array("body")))


@query(
    "k04_by_day",
    "SELECT strftime(ts, '%Y%m%d') AS day, COUNT(*) AS n FROM v_failures GROUP BY 1",
    ["v_failures"],
)
def k04(spark, sf):
    return files.with_day(failures(spark, sf)).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k04_by_day_files",
    "SELECT strftime(ts, '%Y%m%d') AS day, url, COUNT(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM v_failures GROUP BY ALL",
    ["v_failures"],
)
def k04_files(spark, sf):
    """Day folders, written and read back."""
    folder = scratch_folder(spark)
    files.write_by_day(failures(spark, sf), folder)
    back = spark.read.schema("event_id long, url string, day string").json(folder)
    return back.groupBy("day", "url").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "k05_per_url_files",
    "SELECT url, COUNT(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM v_failures GROUP BY 1",
    ["v_failures"],
)
def k05_files(spark, sf):
    """URL folders, written in files of a thousand rows and read back."""
    folder = scratch_folder(spark)
    files.write_per_url(failures(spark, sf), folder, rows_per_file=1000)
    back = spark.read.schema("event_id long, url string").json(folder)
    return back.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "k05_per_url_totals",
    "SELECT url, COUNT(*) AS n FROM v_failures GROUP BY ROLLUP (url)",
    ["v_failures"],
)
def k05(spark, sf):
    return files.per_url_totals(failures(spark, sf))


@query(
    "x20_truncation",
    "SELECT doc_id, substr(text, 1, 200) AS short, substr(text, 1, 300) AS middle, substr(text, 1, 1000) AS long, substr(md5(text), 1, 8) AS sha FROM documents",
)
def x20(spark, sf):
    text = F.col("text")
    cut = lambda n, name: F.substring(text, 1, n).alias(name)
    return table(spark, sf, "documents").select(
        "doc_id", cut(200, "short"), cut(300, "middle"), cut(1000, "long"), F.substring(F.md5(text), 1, 8).alias("sha")
    )
