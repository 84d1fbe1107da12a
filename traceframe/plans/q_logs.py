"""Log queries: scans, patterns, tracebacks, context, labels and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.operators import logs
from traceframe.plans.registry import query
from traceframe.plans.views import table, view
from traceframe.session import spread
from traceframe.sources import text_lines

_TYPES = "|".join(logs.BUILTIN_TYPES)
_APP = logs.APP_PREFIX
_FILE = r'File\s+"(.*?\.py)",\s+line\s+(\d+)'

# the six stream patterns in DuckDB, first match wins
HITS = rf"""
hits AS (SELECT *,
  regexp_matches(line, '{_APP}Traceback\s*\(most recent call last\):', 'i') AS p1,
  regexp_matches(line, '{_APP}(\w+(?:Exception|Error)):\s*([^\n]*)', 'i') AS p2,
  regexp_matches(line, '{_APP}{_FILE}', 'i') AS p3,
  regexp_matches(line, 'Traceback\s*\(most recent call last\):', 'i') AS p4,
  regexp_matches(line, '{_FILE}', 'i') AS p5,
  regexp_matches(line, '({_TYPES}):\s*([^\n]*)', 'i') AS p6
  FROM v_lines),
hit AS (SELECT *,
  CASE WHEN p1 THEN 'app_python_traceback_start' WHEN p2 THEN 'app_python_exception' WHEN p3 THEN 'app_python_file'
       WHEN p4 THEN 'python_traceback_start' WHEN p5 THEN 'python_file_line' WHEN p6 THEN 'python_exception' END AS pattern,
  CASE WHEN p1 THEN 'Traceback' WHEN p2 THEN regexp_extract(line, '{_APP}(\w+(?:Exception|Error)):\s*([^\n]*)', 4, 'i')
       WHEN p3 THEN 'UnknownException' WHEN p4 THEN 'Traceback' WHEN p5 THEN 'UnknownException'
       WHEN p6 THEN regexp_extract(line, '({_TYPES}):\s*([^\n]*)', 1, 'i') END AS exception_type,
  CASE WHEN p1 THEN trim(line) WHEN p2 THEN regexp_extract(line, '{_APP}(\w+(?:Exception|Error)):\s*([^\n]*)', 5, 'i')
       WHEN p6 AND NOT p3 AND NOT p4 AND NOT p5 THEN regexp_extract(line, '({_TYPES}):\s*([^\n]*)', 2, 'i')
       WHEN p3 OR p4 OR p5 THEN trim(line) END AS message,
  CASE WHEN p1 OR p2 OR p3 THEN regexp_extract(line, '{_APP}', 1) END AS app_name,
  CASE WHEN p1 OR p2 OR p3 THEN regexp_extract(line, '{_APP}', 2) END AS version,
  CASE WHEN p1 OR p2 OR p3 THEN regexp_extract(line, '{_APP}', 3) END AS process
  FROM hits)"""

SEVERITY = """CASE WHEN exception_type IN ('MemoryError','SystemError','SystemExit','KeyboardInterrupt','RecursionError','OverflowError')
  THEN 'CRITICAL' WHEN lower(pattern) LIKE '%python%' OR lower(exception_type) LIKE '%exception%' OR lower(exception_type) LIKE '%error%'
  THEN 'ERROR' ELSE 'INFO' END"""

# tracebacks as plain per-stream windows: the reading the chunked form must agree with
TRACES = f"""{HITS},
flags AS (SELECT *, CASE WHEN line LIKE '%Traceback (most recent call last)%' THEN 1 ELSE 0 END AS tb,
  CASE WHEN p5 THEN 1 ELSE 0 END AS fl,
  CASE WHEN pattern IN ('app_python_exception', 'python_exception') THEN 1 ELSE 0 END AS ex FROM hit),
numbered AS (SELECT *, SUM(tb) OVER (PARTITION BY stream_id ORDER BY line_no) AS trace_id,
  CASE WHEN ex = 1 AND tb = 0 AND fl = 0 THEN 1 ELSE 0 END AS ends FROM flags),
ended AS (SELECT *, MIN(CASE WHEN ends = 1 THEN line_no END) OVER (PARTITION BY stream_id, trace_id) AS end_no FROM numbered),
marked AS (SELECT *, CASE WHEN trace_id > 0 AND end_no IS NOT NULL AND line_no <= end_no THEN 1 ELSE 0 END AS traced FROM ended),
traces AS (SELECT stream_id, end_no, string_agg(trim(line), chr(10) ORDER BY line_no) AS stack, COUNT(*) AS stack_lines,
  max(CASE WHEN tb = 1 THEN app_name END) AS open_app, max(CASE WHEN tb = 1 THEN version END) AS open_version
  FROM marked WHERE traced = 1 GROUP BY stream_id, trace_id, end_no),
events AS (
  SELECT m.stream_id, m.line_no, m.ts, m.pattern, m.exception_type, m.message, 'ERROR' AS severity,
    coalesce(m.app_name, t.open_app) AS app_name, coalesce(m.version, t.open_version) AS version, t.stack, t.stack_lines
  FROM marked m JOIN traces t ON m.stream_id = t.stream_id AND m.line_no = t.end_no
  UNION ALL
  SELECT stream_id, line_no, ts, 'python_traceback_start', 'PythonTraceback', 'Python traceback started', 'ERROR',
    app_name, version, trim(line), 1 FROM marked WHERE tb = 1
  UNION ALL
  SELECT stream_id, line_no, ts, pattern, exception_type, message, {SEVERITY}, app_name, version, '', 0
  FROM marked WHERE traced = 0 AND tb = 0 AND fl = 0 AND pattern IS NOT NULL)"""


def lines(spark, sf):
    return spread(view(spark, sf, "v_lines"))


def hit_columns(df, *extra):
    return df.select(
        "stream_id",
        "line_no",
        F.col("hit.pattern").alias("pattern"),
        F.col("hit.exception_type").alias("exception_type"),
        F.col("hit.message").alias("message"),
        F.col("hit.app_name").alias("app_name"),
        *extra,
    )


def hits(spark, sf):
    return hit_columns(logs.detect_lines(lines(spark, sf)).where(F.col("hit").isNotNull()))


def events(spark, sf, reach=None):
    return logs.exception_events(lines(spark, sf), reach=reach)


@query(
    "s01_line_scan",
    """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no, line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    WHERE trim(line, ' ' || chr(9) || chr(13) || chr(10)) <> ''""",
)
def s01(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return text_lines.lines_of_text(docs, "text").select("doc_id", "line_no", "line")


@query(
    "s02_stream_fan_in",
    """SELECT 'stream' || stream_id AS stream_id, 'https://logs.example.org/?feed=' || stream_id AS url, COUNT(*) AS n,
    CAST(SUM(length(line)) AS BIGINT) AS chars FROM v_lines GROUP BY ALL""",
    ["v_lines"],
)
def s02(spark, sf):
    all_lines = lines(spark, sf)
    streams = {
        f"stream{i}": (f"https://logs.example.org/?feed={i}", all_lines.where(F.col("stream_id") == i).drop("stream_id"))
        for i in range(3)
    }
    merged = text_lines.fan_in(streams)
    return merged.groupBy("stream_id", "url").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars")
    )


@query(
    "s03_line_numbers",
    "SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS line_no, line FROM v_lines",
    ["v_lines"],
)
def s03(spark, sf):
    return logs.number_lines(lines(spark, sf)).select("stream_id", "line_no", "line")


@query(
    "f01_python_related",
    "SELECT stream_id, line_no FROM v_lines WHERE "
    + " OR ".join("contains(line, '%s')" % text for text in logs.PYTHON_INDICATORS),
    ["v_lines"],
)
def f01(spark, sf):
    return lines(spark, sf).where(logs.is_python_related(F.col("line"))).select("stream_id", "line_no")


@query(
    "f02_first_pattern",
    f"WITH {HITS} SELECT stream_id, line_no, pattern, exception_type, message, app_name FROM hit WHERE pattern IS NOT NULL",
    ["v_lines"],
)
def f02(spark, sf):
    return hits(spark, sf)


@query(
    "f02_prefixed_pattern",
    "WITH h AS (SELECT *, CASE "
    + " ".join(
        f"WHEN regexp_matches(line, '{_APP}({types}):', 'i') THEN '{name}'" for name, types in logs.PREFIXED_TYPES
    )
    + " END AS pattern FROM v_lines) SELECT stream_id, line_no, pattern, "
    + f"regexp_extract(line, '{_APP}(\\w+):\\s*([^\\n]*)', 4, 'i') AS exception_type, "
    + f"regexp_extract(line, '{_APP}(\\w+):\\s*([^\\n]*)', 5, 'i') AS message, "
    + f"regexp_extract(line, '{_APP}', 1) AS app_name FROM h WHERE pattern IS NOT NULL",
    ["v_lines"],
)
def f02_prefixed(spark, sf):
    return hit_columns(logs.detect_prefixed(lines(spark, sf)))


# the prefixed detector as a state that lines set or leave: plain windows over whole streams
_PY = " OR ".join("contains(line, '%s')" % text for text in logs.PYTHON_INDICATORS)
_CASES = " ".join(f"WHEN regexp_matches(line, '{_APP}({types}):', 'i') THEN '{name}'" for name, types in logs.PREFIXED_TYPES)


@query(
    "f02_trace_aware",
    rf"""WITH p AS (SELECT *, contains(line, '{logs.TRACEBACK_MARK}') AS tb FROM v_lines WHERE {_PY}),
    h AS (SELECT *, CASE WHEN NOT tb THEN CASE {_CASES} END END AS pat, NOT tb AND regexp_matches(line, '{_APP}{_FILE}', 'i') AS fl,
      tb AND regexp_matches(line, '{_APP}Traceback\s*\(most recent call last\):', 'i') AS opens FROM p),
    m AS (SELECT *, pat IS NOT NULL AND NOT fl AS ends FROM h),
    s AS (SELECT *, last_value(CASE WHEN tb THEN line_no WHEN ends THEN -1 END IGNORE NULLS) OVER w AS state,
      last_value(CASE WHEN opens THEN line_no WHEN ends THEN -1 END IGNORE NULLS) OVER w AS app
      FROM m WINDOW w AS (PARTITION BY stream_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT *, CASE WHEN tb THEN line_no WHEN state >= 0 THEN state END AS trace_start FROM s),
    e AS (SELECT *, CASE WHEN tb THEN 'traceback_start' WHEN trace_start IS NOT NULL AND fl THEN 'python_file' WHEN pat IS NOT NULL THEN 'python_exception' END AS type,
      CASE WHEN opens THEN line_no WHEN trace_start IS NOT NULL AND app >= 0 THEN app END AS src FROM t)
    SELECT e.stream_id, e.line_no, e.type, CASE WHEN e.type = 'python_exception' THEN pat END AS pattern,
      CASE WHEN e.type = 'python_exception' THEN regexp_extract(e.line, '{_APP}(\w+):\s*([^\n]*)', 4, 'i') END AS exception_type,
      CASE WHEN e.type = 'python_file' THEN regexp_extract(e.line, '{_FILE}', 1, 'i') END AS filename,
      CASE WHEN e.type = 'python_file' THEN CAST(regexp_extract(e.line, '{_FILE}', 2, 'i') AS BIGINT) END AS line_number,
      CASE WHEN trace_start IS NULL THEN regexp_extract(e.line, '{_APP}', 1) WHEN src IS NOT NULL THEN regexp_extract(o.line, '{_APP}', 1) END AS app_name,
      trace_start FROM e LEFT JOIN v_lines o ON o.stream_id = e.stream_id AND o.line_no = e.src WHERE e.type IS NOT NULL""",
    ["v_lines"],
)
def f02_trace_aware(spark, sf):
    found = logs.prefixed_events(lines(spark, sf))
    return found.select("stream_id", "line_no", "type", "pattern", "exception_type", "filename", "line_number", "app_name", F.col("trace_start").cast("long").alias("trace_start"))


@query(
    "f03_user_pattern",
    r"""SELECT stream_id, line_no, 'python_signup' AS pattern, 'signup' AS exception_type,
    regexp_extract(line, '(signup) user (\d+)', 2) AS message FROM v_lines WHERE regexp_matches(line, '(signup) user (\d+)', 'i')""",
    ["v_lines"],
)
def f03(spark, sf):
    mine = logs.LinePattern.named("python_signup", r"(?P<exception_type>signup) user (?P<message>\d+)")
    found = logs.detect_lines(lines(spark, sf), [mine]).where(F.col("hit.pattern") == mine.name)
    return hit_columns(found).drop("app_name")


@query(
    "f04_app_prefix",
    rf"""SELECT stream_id, line_no, app_name, app_version, process_id,
    app_name || '<' || app_version || '>(' || process_id || ')' AS full_app_info FROM (
      SELECT stream_id, line_no, coalesce(nullif(regexp_extract(line, '{_APP}', 1), ''), 'unknown') AS app_name,
      coalesce(nullif(regexp_extract(line, '{_APP}', 2), ''), 'unknown') AS app_version,
      coalesce(nullif(regexp_extract(line, '{_APP}', 3), ''), 'unknown') AS process_id FROM v_lines)""",
    ["v_lines"],
)
def f04(spark, sf):
    return lines(spark, sf).select("stream_id", "line_no", *logs.app_fields(F.col("line")))


@query(
    "f05_severity",
    f"WITH {HITS} SELECT stream_id, line_no, {SEVERITY} AS severity FROM hit WHERE pattern IS NOT NULL",
    ["v_lines"],
)
def f05(spark, sf):
    found = hits(spark, sf)
    return found.select(
        "stream_id", "line_no", logs.severity(F.col("pattern"), F.col("exception_type")).alias("severity")
    )


@query(
    "f06_emit_rule",
    f"""WITH {HITS} SELECT stream_id, line_no, pattern FROM hit
    WHERE lower(pattern) LIKE '%python%' AND pattern NOT IN ('python_file_line', 'app_python_file')""",
    ["v_lines"],
)
def f06(spark, sf):
    return hits(spark, sf).where(logs.is_emitted(F.col("pattern"))).select("stream_id", "line_no", "pattern")


_ADVICE = (
    "CASE "
    + " ".join(f"WHEN lower(exception_type) LIKE '%{word}%' THEN '{label}'" for word, label in logs.ADVICE_BY_TYPE)
    + " WHEN lower(exception_type) LIKE '%exception%' AND lower(message) LIKE '%jwt%' THEN 'token'"
    + " WHEN lower(exception_type) LIKE '%exception%' AND lower(message) LIKE '%team\\_id%' ESCAPE '\\' THEN 'team'"
    + " WHEN lower(exception_type) LIKE '%exception%' THEN 'general' END"
)


@query(
    "f07_advice",
    f"WITH {HITS} SELECT stream_id, line_no, {_ADVICE} AS advice FROM hit WHERE pattern IS NOT NULL",
    ["v_lines"],
)
def f07(spark, sf):
    return hits(spark, sf).select(
        "stream_id", "line_no", logs.advice(F.col("exception_type"), F.col("message")).alias("advice")
    )


@query(
    "f08_version_band",
    rf"""SELECT version_band, COUNT(*) AS n FROM (SELECT CASE WHEN v = 'unknown' THEN NULL WHEN TRY_CAST(v AS INT) < 1000 THEN 'low'
    WHEN TRY_CAST(v AS INT) > 2000 THEN 'recent' WHEN TRY_CAST(v AS INT) IS NULL THEN v END AS version_band FROM (
    SELECT coalesce(nullif(regexp_extract(line, '{_APP}', 2), ''), 'unknown') AS v FROM v_lines)) GROUP BY 1""",
    ["v_lines"],
)
def f08(spark, sf):
    version = lines(spark, sf).select(logs.app_fields(F.col("line"))[1])
    return version.groupBy(logs.version_band(F.col("app_version")).alias("version_band")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "f09_syntax_flag",
    """SELECT doc_id, regexp_matches(lower(text), 'syntax|parse|compilation') AS is_syntax FROM documents""",
)
def f09(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", logs.is_syntax_error(F.col("text")).alias("is_syntax"))


@query(
    "f10_priority_label",
    f"""WITH {TRACES} SELECT priority, COUNT(*) AS n FROM (SELECT CASE WHEN lower(pattern) LIKE '%syntax%' THEN 'CRITICAL - SYNTAX ERROR'
    WHEN severity = 'CRITICAL' THEN 'CRITICAL' WHEN severity = 'ERROR' THEN 'ERROR' ELSE 'WARNING' END AS priority FROM events) GROUP BY 1""",
    ["v_lines"],
)
def f10(spark, sf):
    label = logs.priority_label(logs.is_syntax_error(F.col("pattern")), F.col("severity"))
    return events(spark, sf).groupBy(label.alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f11_stream_of_url",
    r"""SELECT feed, ref, COUNT(*) AS n FROM (
    SELECT coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), 'unknown') AS feed,
    coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), 'unknown') AS ref FROM pages) GROUP BY ALL""",
)
def f11(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.groupBy(
        logs.stream_of_url(F.col("url"), "page").alias("feed"), logs.stream_of_url(F.col("url"), "ref").alias("ref")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "w07_tracebacks",
    f"""WITH {TRACES} SELECT stream_id, line_no, pattern, exception_type, message, severity, app_name, version,
    stack, stack_lines FROM events""",
    ["v_lines"],
)
def w07(spark, sf):
    found = events(spark, sf, reach=1000)
    return found.select(
        "stream_id",
        "line_no",
        "pattern",
        "exception_type",
        "message",
        "severity",
        "app.app_name",
        "app.version",
        F.array_join("stacktrace", "\n").alias("stack"),
        F.size("stacktrace").cast("long").alias("stack_lines"),
    )


@query(
    "w07_trace_rows",
    f"""WITH {TRACES}, begun AS (SELECT *, min(line_no) OVER (PARTITION BY stream_id, trace_id) AS trace_start FROM marked WHERE traced = 1)
    SELECT stream_id, trace_start, end_no AS trace_end, line_no, trim(line) AS text FROM begun""",
    ["v_lines"],
)
def w07_rows(spark, sf):
    marked = logs.trace_lines(logs.detect_lines(lines(spark, sf)))
    return logs.trace_rows(marked).select("stream_id", F.col("trace_start").cast("long").alias("trace_start"), F.col("trace_end").cast("long").alias("trace_end"), "line_no", "text")


@query(
    "w01_context_ring",
    """WITH n AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS line_no, ts, line FROM v_lines),
    c AS (SELECT *, string_agg('[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '] Line ' || line_no || ': ' || trim(line), chr(10))
      OVER (PARTITION BY stream_id ORDER BY line_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS context FROM n)
    SELECT stream_id, line_no, context FROM c WHERE line LIKE '%Traceback (most recent call last)%'""",
    ["v_lines"],
)
def w01(spark, sf):
    numbered = logs.number_lines(lines(spark, sf))
    starts = numbered.where(F.col("line").contains(logs.TRACEBACK_MARK)).select("stream_id", "line_no")
    return logs.with_context(starts, numbered, 10).select(
        "stream_id", "line_no", F.array_join("context_lines", "\n").alias("context")
    )


@query(
    "j01_stream_labels",
    f"""WITH {TRACES} SELECT name, priority, COUNT(*) AS n FROM (SELECT coalesce(n_name, 'Unknown') AS name,
    CASE WHEN n_regionkey IS NULL THEN 'LOW' WHEN n_regionkey = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS priority
    FROM events LEFT JOIN nation ON stream_id = n_nationkey * 2) GROUP BY ALL""",
    ["v_lines"],
)
def j01(spark, sf):
    streams = table(spark, sf, "nation").select(
        (F.col("n_nationkey") * 2).cast("long").alias("stream_id"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_regionkey") == 0, "HIGH").otherwise("MEDIUM").alias("priority"),
    )
    labelled = logs.label_streams(events(spark, sf), streams)
    return labelled.groupBy("name", "priority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a01_exception_counts",
    f"""WITH {TRACES}, e AS (SELECT exception_type, severity, CAST(stream_id AS VARCHAR) AS stream_id,
      coalesce(version, 'unknown') AS version, coalesce(app_name, 'unknown') AS app_name FROM events)
    SELECT 'exception_type' AS dimension, exception_type AS value, COUNT(*) AS n FROM e GROUP BY 2 UNION ALL
    SELECT 'severity', severity, COUNT(*) FROM e GROUP BY 2 UNION ALL SELECT 'stream_id', stream_id, COUNT(*) FROM e GROUP BY 2 UNION ALL
    SELECT 'version', version, COUNT(*) FROM e GROUP BY 2 UNION ALL SELECT 'app_name', app_name, COUNT(*) FROM e GROUP BY 2""",
    ["v_lines"],
)
def a01(spark, sf):
    flat = events(spark, sf).select(
        "exception_type",
        "severity",
        "stream_id",
        F.coalesce("app.version", F.lit("unknown")).alias("version"),
        F.coalesce("app.app_name", F.lit("unknown")).alias("app_name"),
    )
    return logs.exception_counts(flat, ["exception_type", "severity", "stream_id", "version", "app_name"])


@query(
    "a03_rate_per_minute",
    f"""WITH {TRACES} SELECT stream_id, COUNT(*) AS total,
    round(COUNT(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 0) * 60, 6) AS per_minute FROM events GROUP BY 1""",
    ["v_lines"],
)
def a03(spark, sf):
    return logs.rate_per_minute(events(spark, sf), ["stream_id"])
