"""Log lines to exception events: ordered patterns, tracebacks, context, labels and counts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.operators.ordered import CHUNK_ROWS, context_before, number_chunk, number_rows, ordered_scan

# Texts that decide what a line is. They must not change for results to stay the same.
TRACEBACK_MARK = "Traceback (most recent call last)"
PYTHON_INDICATORS = (
    "Traceback (most recent call last)",
    'File "',
    '.py", line',
    "Exception:",
    "Error:",
    "SyntaxError:",
    "ImportError:",
    "AttributeError:",
    "TypeError:",
    "ValueError:",
    "KeyError:",
    "IndexError:",
    "NameError:",
)
CRITICAL_TYPES = (
    "MemoryError",
    "SystemError",
    "SystemExit",
    "KeyboardInterrupt",
    "RecursionError",
    "OverflowError",
)
BUILTIN_TYPES = (
    "AttributeError", "TypeError", "ValueError", "NameError", "KeyError", "IndexError", "ImportError",
    "ModuleNotFoundError", "SyntaxError", "IndentationError", "TabError", "RuntimeError", "RecursionError",
    "MemoryError", "OverflowError", "ZeroDivisionError", "FloatingPointError", "ArithmeticError",
    "LookupError", "AssertionError", "SystemError", "SystemExit", "KeyboardInterrupt", "GeneratorExit",
    "StopIteration", "StopAsyncIteration", "Exception", "BaseException",
)
PREFIXED_TYPES = (
    ("syntax_error", "SyntaxError"),
    ("indentation_error", "IndentationError|TabError"),
    ("import_error", "ImportError|ModuleNotFoundError"),
    ("attribute_error", "AttributeError"),
    ("type_error", "TypeError"),
    ("value_error", "ValueError"),
    ("key_error", "KeyError"),
    ("index_error", "IndexError"),
    ("name_error", "NameError"),
    ("runtime_error", "RuntimeError|RecursionError|MemoryError"),
    ("general_exception", "Exception"),
)
ADVICE_BY_TYPE = (
    ("syntaxerror", "syntax"),
    ("indentationerror", "indentation"),
    ("taberror", "indentation"),
    ("importerror", "import"),
    ("modulenotfounderror", "import"),
    ("attributeerror", "attribute"),
    ("typeerror", "type"),
    ("valueerror", "value"),
    ("keyerror", "key"),
    ("indexerror", "index"),
    ("nameerror", "name"),
)
SYNTAX_WORDS = ("syntax", "parse", "compilation")

APP_PREFIX = r"(\w+)<(\d+)>\((\d+)\)\s+"
FILE_REF = r'File\s+"(.*?\.py)",\s+line\s+(\d+)'
START_NAME = "python_traceback_start"
FILE_NAME = "python_file_line"
END_NAMES = ("app_python_exception", "python_exception")


@dataclass(frozen=True)
class LinePattern:
    """One named pattern; the numbers say which regex group holds which field (0 = absent)."""

    name: str
    regex: str
    type_group: int = 0
    message_group: int = 0
    app_group: int = 0  # version and process follow it
    severity_group: int = 0

    @classmethod
    def named(cls, name: str, regex: str, ignore_case: bool = True) -> LinePattern:
        """User pattern with ``(?P<exception_type>…)``, ``(?P<message>…)``, ``(?P<app_name>…)``, ``(?P<severity>…)``."""
        groups = dict(re.compile(regex).groupindex)
        return cls(
            name,
            ("(?i)" if ignore_case else "") + numbered_groups(regex, groups),
            groups.get("exception_type", 0),
            groups.get("message", 0),
            groups.get("app_name", 0),
            groups.get("severity", 0),
        )


def numbered_groups(regex: str, groups: dict[str, int]) -> str:
    """The regex with groups and references by number: names may hold what Java's names may not.

    ``(?P<n>…)`` becomes a plain group and ``(?P=n)`` the reference to its number, closed off so that a digit
    behind it is not read as part of it. Escaped characters and character classes stay as they are.
    """
    out, at, inside = [], 0, False
    while at < len(regex):
        if regex[at] == "\\":
            out.append(regex[at : at + 2])
            at += 2
            continue
        if not inside and (opened := re.compile(r"\(\?P<\w+>").match(regex, at)):
            out.append("(")
            at = opened.end()
            continue
        if not inside and (named := re.compile(r"\(\?P=(\w+)\)").match(regex, at)):
            out.append(f"(?:\\{groups[named[1]]})")
            at = named.end()
            continue
        if regex[at] == "[" and not inside:
            # a bracket right behind the opening one (or behind its ^) is a member
            first = re.compile(r"\[\^?\]?").match(regex, at)
            out.append(first[0].replace("]", r"\]"))
            at, inside = first.end(), True
            continue
        if regex[at] == "]":
            inside = False
        out.append(r"\[" if inside and regex[at] == "[" else regex[at])
        at += 1
    return "".join(out)


STREAM_PATTERNS = (
    LinePattern("app_python_traceback_start", "(?i)" + APP_PREFIX + r"(Traceback)\s*\(most recent call last\):", 4, 0, 1),
    LinePattern("app_python_exception", "(?i)" + APP_PREFIX + r"(\w+(?:Exception|Error)):\s*([^\n]*)", 4, 5, 1),
    LinePattern("app_python_file", "(?i)" + APP_PREFIX + FILE_REF, 0, 0, 1),
    LinePattern(START_NAME, r"(?i)(Traceback)\s*\(most recent call last\):", 1),
    LinePattern(FILE_NAME, "(?i)" + FILE_REF),
    LinePattern("python_exception", "(?i)(" + "|".join(BUILTIN_TYPES) + r"):\s*([^\n]*)", 1, 2),
)
APP_FIELDS = ("app_name", "version", "process")
PREFIXED_START = "(?i)" + APP_PREFIX + r"(Traceback)\s*\(most recent call last\):"
PREFIXED_FILE = "(?i)" + APP_PREFIX + FILE_REF
PREFIXED_PATTERNS = tuple(
    LinePattern(name, f"(?i){APP_PREFIX}({types}):" + r"\s*([^\n]*)", 4, 5, 1) for name, types in PREFIXED_TYPES
)


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def number_lines(lines: DataFrame, key: str = "stream_id", order: str = "line_no") -> DataFrame:
    """Replace a sparse but unique position by dense 1-based line numbers per stream."""
    blank_free = lines.where(F.trim("line") != "").withColumn("__chunk", number_chunk(F.col(order)))
    numbered = number_rows(blank_free, [key], "__chunk", [order], "__no")
    return numbered.withColumn(order, F.col("__no")).drop("__chunk", "__no")


def is_python_related(line: Column) -> Column:
    """Cheap case-sensitive substring test to run before any regex."""
    return any_of([line.contains(text) for text in PYTHON_INDICATORS])


def _maybe_stream_hit(line: Column) -> Column:
    """Superset of what the built-in stream patterns can match, without a regex."""
    low = F.lower(line)
    return any_of([low.contains(w) for w in ("error", "exception", "traceback", ".py", "exit", "interrupt", "iteration")])


def first_match(line: Column, patterns: Sequence[LinePattern], guard: Column | None = None) -> Column:
    """First pattern that matches, as ``struct(pattern, exception_type, message, app_name, version, process)``.

    Patterns are tried in order and later ones are not evaluated after a hit.
    """
    absent = F.lit(None).cast("string")

    def fields(p: LinePattern) -> Column:
        group = lambda g: F.regexp_extract(line, p.regex, g) if g else absent
        app = [group(p.app_group + i) if p.app_group else absent for i in range(3)]
        return F.struct(
            F.lit(p.name).alias("pattern"),
            (group(p.type_group) if p.type_group else F.lit("UnknownException")).alias("exception_type"),
            (group(p.message_group) if p.message_group else F.trim(line)).alias("message"),
            app[0].alias("app_name"),
            app[1].alias("version"),
            app[2].alias("process"),
            (F.nullif(F.upper(group(p.severity_group)), F.lit("")) if p.severity_group else absent).alias("severity"),
        )

    hit = None
    for p in patterns:
        test = F.rlike(line, F.lit(p.regex))
        hit = F.when(test, fields(p)) if hit is None else hit.when(test, fields(p))
    return hit if guard is None else F.when(guard, hit)


def detect_lines(lines: DataFrame, extra: Sequence[LinePattern] = (), line: str = "line") -> DataFrame:
    """Stateless classification: ``hit``, ``is_start``, ``is_file``, ``is_exc`` per line.

    ``extra`` patterns are tried after the built-in ones.
    """
    text = F.col(line)
    hit = first_match(text, STREAM_PATTERNS, _maybe_stream_hit(text))
    if extra:
        hit = F.coalesce(hit, first_match(text, extra))
    is_start = text.contains(TRACEBACK_MARK)
    # a file line counts as one wherever it stands, so it is never taken for the exception itself
    is_file = F.lower(text).contains('.py"') & F.rlike(text, F.lit("(?i)" + FILE_REF))
    ends = F.coalesce(F.col("hit.pattern").isin(*END_NAMES), F.lit(False))
    once = evaluate_once(lines.withColumn("is_start", is_start), F.struct(hit.alias("hit"), (is_file & ~is_start).alias("is_file")))
    return once.withColumn("is_exc", ends & ~F.col("is_start") & ~F.col("is_file"))


def evaluate_once(df: DataFrame, fields: Column) -> DataFrame:
    """Add the fields of a struct as columns that are computed once per row.

    A plain projection would be merged with the ones above it, and its regexes would run again for
    every later use; a one-element generator keeps them apart and stays inside codegen.
    """
    return df.select("*", F.inline(F.array(fields)))


def detect_prefixed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Stateless form of the prefixed detector: only lines ``name<version>(pid) Type: message``."""
    text = F.col(line)
    hit = first_match(text, PREFIXED_PATTERNS, is_python_related(text))
    return evaluate_once(lines, F.struct(hit.alias("hit"))).where(F.col("hit").isNotNull())


def prefixed_events(lines: DataFrame, key: str = "stream_id", order: str = "line_no") -> DataFrame:
    """Trace-aware form of the prefixed detector: ``traceback_start``, ``python_file`` and ``python_exception`` events.

    Per event: type, pattern, exception_type, message, filename, line_number, app_name, version, process, trace_start (null
    outside of a trace), log_line. Lines that are not Python-related neither count nor change anything. A traceback line opens
    a trace, also inside an open one; in a trace a file line gives file name and line number and never ends it; a prefixed
    exception ends it. In a trace the app is that of the last prefixed traceback line since the trace before ended, and
    unknown (null) without one; outside it is the exception's own.

    What a line does to the state is to set it or to leave it, so a chunk of lines comes down to the last thing that one
    of them set, and chunks are composed by a scan: no stream is in one task, however long a trace is.
    """
    text, place = F.col("line"), F.col(order).cast("long")
    is_start = text.contains(TRACEBACK_MARK)
    tests = evaluate_once(
        lines.where(is_python_related(text)).withColumn("is_start", is_start),
        F.struct(
            F.when(~is_start, first_match(text, PREFIXED_PATTERNS)).alias("hit"),
            F.when(~is_start & F.rlike(text, F.lit(PREFIXED_FILE)), F.struct(F.regexp_extract(text, PREFIXED_FILE, 4).alias("filename"), F.regexp_extract(text, PREFIXED_FILE, 5).alias("line_number"))).alias("at"),
            F.when(is_start & F.rlike(text, F.lit(PREFIXED_START)), F.struct(*(F.regexp_extract(text, PREFIXED_START, i).alias(n) for i, n in enumerate(APP_FIELDS, 1)))).alias("opens"),
        ),
    )
    ends = F.col("hit").isNotNull() & F.col("at").isNull()
    scanned = ordered_scan(
        tests.withColumn("__chunk", number_chunk(F.col(order))), [key], "__chunk", [order],
        last={
            "__state": F.when(F.col("is_start"), place * 2 + 1).when(ends, place * 2),
            "__app": F.when(F.col("opens").isNotNull(), place * 2 + 1).when(ends, place * 2),
        },
    )
    half = lambda c: F.when(F.col(c) % 2 == 1, F.shiftright(c, 1))
    begin = F.when(F.col("is_start"), place).otherwise(half("__state"))
    in_file = begin.isNotNull() & F.col("at").isNotNull()
    kind = F.when(F.col("is_start"), "traceback_start").when(in_file, "python_file").when(F.col("hit").isNotNull(), "python_exception")
    placed = (
        scanned.withColumn("type", kind).where(F.col("type").isNotNull()).withColumn("trace_start", begin)
        .withColumn("__from", F.when(F.col("opens").isNotNull(), place).when(begin.isNotNull(), half("__app")))
    )
    # the app of a trace is on its traceback line, met by an equal line number
    openers = tests.where("opens is not null").select(F.col(key).alias("__key"), place.alias("__no"), "opens")
    joined = placed.drop("opens").join(openers, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__from") == F.col("__no")), "left")
    thrown = F.col("type") == "python_exception"
    return joined.select(
        key, order, "type", *(F.when(thrown, F.col(f"hit.{f}")).alias(f) for f in ("pattern", "exception_type", "message")),
        F.when(F.col("type") == "python_file", F.col("at.filename")).alias("filename"),
        F.when(F.col("type") == "python_file", F.col("at.line_number").cast("long")).alias("line_number"),
        *(F.when(F.col("trace_start").isNull(), F.col(f"hit.{f}")).otherwise(F.col(f"opens.{f}")).alias(f) for f in APP_FIELDS),
        "trace_start", F.trim("line").alias("log_line"),
    )


def app_fields(line: Column) -> list[Column]:
    """App name, version and process of ``name<version>(pid)``, else ``unknown``; and the joined form."""
    get = lambda g: F.coalesce(F.nullif(F.regexp_extract(line, APP_PREFIX, g), F.lit("")), F.lit("unknown"))
    name, version, process = get(1), get(2), get(3)
    return [
        name.alias("app_name"),
        version.alias("app_version"),
        process.alias("process_id"),
        F.format_string("%s<%s>(%s)", name, version, process).alias("full_app_info"),
    ]


def severity(pattern: Column, exception_type: Column) -> Column:
    low = F.lower(exception_type)
    return (
        F.when(exception_type.isin(*CRITICAL_TYPES), "CRITICAL")
        .when(F.lower(pattern).contains("python") | low.contains("exception") | low.contains("error"), "ERROR")
        .otherwise("INFO")
    )


def is_emitted(pattern: Column) -> Column:
    """Only Python events leave the detector, and file lines never do."""
    return F.lower(pattern).contains("python") & ~pattern.isin(FILE_NAME, "app_python_file")


def advice(exception_type: Column, message: Column) -> Column:
    """Advice category by type, and by message keyword for plain exceptions; null when none applies."""
    kind, text = F.lower(exception_type), F.lower(message)
    branch = None
    for word, label in ADVICE_BY_TYPE:
        test = kind.contains(word)
        branch = F.when(test, label) if branch is None else branch.when(test, label)
    plain = kind.contains("exception")
    return (
        branch.when(plain & text.contains("jwt"), "token")
        .when(plain & text.contains("team_id"), "team")
        .when(plain, "general")
    )


def version_band(version: Column) -> Column:
    number = version.try_cast("int")
    return (
        F.when(version == "unknown", F.lit(None).cast("string"))
        .when(number < 1000, "low")
        .when(number > 2000, "recent")
        .when(number.isNull(), version)
    )


def is_syntax_error(pattern: Column) -> Column:
    return any_of([F.lower(pattern).contains(word) for word in SYNTAX_WORDS])


def priority_label(syntax: Column, level: Column) -> Column:
    return (
        F.when(syntax, "CRITICAL - SYNTAX ERROR")
        .when(level == "CRITICAL", "CRITICAL")
        .when(level == "ERROR", "ERROR")
        .otherwise("WARNING")
    )


def stream_of_url(url: Column, parameter: str) -> Column:
    """Value of a query parameter of the stream's URL, else ``unknown``."""
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(parameter)), F.lit("unknown"))


def trace_lines(detected: DataFrame, key: str = "stream_id", order: str = "line_no") -> DataFrame:
    """Mark lines of closed tracebacks: adds ``trace_start``, ``trace_end`` and ``total_exceptions_found``.

    A line belongs to a trace when the last start/exception before it is a start, and the trace is
    closed when the next one is an exception. Both are carried across chunks of the stream, so
    neither a busy stream nor a trace that never ends is gathered anywhere. A start inside an open
    trace drops the lines before it.
    """
    place = F.col(order).cast("long")
    mark = F.when(F.col("is_start"), place * 2 + 1).when(F.col("is_exc"), place * 2)
    found = F.when(F.col("hit").isNotNull() & ~F.col("is_file"), 1).otherwise(0).cast("long")
    scanned = ordered_scan(
        detected.withColumn("__chunk", number_chunk(F.col(order))),
        [key],
        "__chunk",
        [order],
        sums={"total_exceptions_found": found},
        last={"__before": mark},
        next={"__after": mark},
    )
    half = lambda c: F.shiftright(c, 1)
    start = F.when(F.col("is_start"), F.col(order)).when(F.col("__before") % 2 == 1, half("__before"))
    end = F.when(F.col("is_exc"), F.col(order)).when(F.col("__after") % 2 == 0, half("__after"))
    return (
        # the start of the trace that a line would belong to if it closes; known without looking ahead
        scanned.withColumn("trace_begin", start)
        .withColumn("trace_end", F.when(F.col("trace_begin").isNotNull(), end))
        .withColumn("trace_start", F.when(F.col("trace_end").isNotNull(), F.col("trace_begin")))
        # lines of the trace still open at the end of the stream: what a later batch must see again
        .withColumn("trace_open", F.col("trace_begin").isNotNull() & ~F.col("is_exc") & F.col("__after").isNull())
        .drop("__before", "__after", "__chunk")
    )


def exception_events(
    lines: DataFrame, extra: Sequence[LinePattern] = (), key: str = "stream_id", order: str = "line_no", reach: int | None = CHUNK_ROWS
) -> DataFrame:
    """Exception events of all streams: traced, untraced and traceback starts.

    ``lines`` needs ``stream_id``, a unique integer ``line_no``, ``ts`` and ``line``. ``reach`` as in :func:`build_events`.
    """
    return build_events(trace_lines(detect_lines(lines, extra), key, order), key, order, reach)


def trace_rows(marked: DataFrame, key: str = "stream_id", order: str = "line_no") -> DataFrame:
    """Closed traces as rows ``(key, trace_start, trace_end, line number, text)``: any number of lines, none gathered."""
    return marked.where(F.col("trace_start").isNotNull()).select(key, "trace_start", "trace_end", order, F.trim("line").alias("text"))


def build_events(marked: DataFrame, key: str = "stream_id", order: str = "line_no", reach: int | None = CHUNK_ROWS) -> DataFrame:
    """Events from marked lines (see :func:`trace_lines`), with ``trace_start`` where a trace was closed.

    Without ``reach`` an event is made of its own line and the first line of its trace; the others are in
    :func:`trace_rows`. With it, ``stacktrace`` holds the trace's lines less than ``reach`` line numbers behind its start,
    which are ``reach`` lines at most.
    """
    traced = F.col("trace_start").isNotNull()
    lone = F.when(F.col("is_start"), F.struct(F.lit("start").alias("kind"), F.col(order).alias("at"))).when(
        ~traced & F.col("hit").isNotNull() & is_emitted(F.col("hit.pattern")) & ~F.col("is_file")
        | (traced & ~F.col("is_exc") & ~F.col("is_file") & F.col("hit").isNotNull() & is_emitted(F.col("hit.pattern"))),
        F.struct(F.lit("lone").alias("kind"), F.col(order).alias("at")),
    )
    part = F.when(traced, F.struct(F.lit("trace").alias("kind"), F.col("trace_end").alias("at")))
    if reach is None:
        part = F.when(F.col("is_start") | F.col("is_exc"), part)
    roles = marked.withColumn("__role", F.explode(F.filter(F.array(part, lone), lambda r: r.isNotNull())))
    text = F.trim("line")
    own = F.struct(
        F.col("ts"),
        F.col("hit"),
        text.alias("log_line"),
        F.col("total_exceptions_found"),
    )
    near = F.when(F.col("trace_start").isNull() | (F.col(order) - F.col("trace_start") < (reach or 0)), F.struct(F.col(order).alias("no"), text.alias("text")))
    grouped = roles.groupBy(key, "__role.kind", "__role.at").agg(
        F.max_by(own, F.when(F.col(order) == F.col("__role.at"), 1)).alias("own"),
        F.max_by(F.col("hit"), F.when(F.col("is_start"), 1)).alias("opened"),
        F.max("trace_start").alias("trace_start"),
        *([] if reach is None else [F.transform(F.array_sort(F.collect_list(near)), lambda p: p["text"]).alias("stacktrace")]),
    )
    kind, hit = F.col("kind"), F.col("own.hit")
    started = kind == "start"
    app = lambda f: F.coalesce(hit[f], F.when(kind == "trace", F.col("opened")[f]))
    return grouped.select(
        key,
        F.col("at").alias(order),
        F.col("own.ts").alias("ts"),
        F.when(started, START_NAME).otherwise(hit["pattern"]).alias("pattern"),
        F.when(started, "PythonTraceback").otherwise(hit["exception_type"]).alias("exception_type"),
        F.when(started, "Python traceback started").otherwise(hit["message"]).alias("message"),
        F.when(kind != "lone", "ERROR")
        .otherwise(F.coalesce(hit["severity"], severity(hit["pattern"], hit["exception_type"])))
        .alias("severity"),
        F.struct(app("app_name").alias("app_name"), app("version").alias("version"), app("process").alias("process")).alias(
            "app"
        ),
        F.when(kind == "trace", F.col("trace_start")).alias("trace_start"),
        *([] if reach is None else [F.when(kind == "lone", F.array().cast("array<string>")).otherwise(F.col("stacktrace")).alias("stacktrace")]),
        F.col("own.log_line").alias("log_line"),
        F.col("own.total_exceptions_found").alias("total_exceptions_found"),
    )


def with_context(
    events: DataFrame, lines: DataFrame, n: int = 50, key: str = "stream_id", order: str = "line_no"
) -> DataFrame:
    """Last ``n`` lines up to and including the event, rendered ``[time] Line i: text``.

    ``line_no`` must be dense (see :func:`number_lines`).
    """
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rendered = F.format_string("[%s] Line %d: %s", stamp, F.col(order), F.trim("line"))
    return context_before(events, lines, [key], order, rendered, n, "context_lines")


def label_streams(events: DataFrame, streams: DataFrame, key: str = "stream_id") -> DataFrame:
    """Left join with the stream dimension; ``Unknown`` / ``LOW`` where it has no entry.

    Spark broadcasts the dimension by its own size threshold; no hint forces it.
    """
    joined = events.join(streams.select(key, "name", "priority"), key, "left")
    return joined.withColumn("name", F.coalesce("name", F.lit("Unknown"))).withColumn(
        "priority", F.coalesce("priority", F.lit("LOW"))
    )


def exception_counts(events: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts by each dimension in one pass: ``(dimension, value, n)``, largest first."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return (
        events.select(F.explode(pairs).alias("p"))
        .groupBy("p.dimension", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("dimension", F.desc("n"), "value")
    )


def rate_per_minute(events: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Total, first and last time, and events per minute (null for a zero duration)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    seconds = (F.max(micros) - F.min(micros)) / 1_000_000
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.count(F.lit(1)) / F.nullif(seconds, F.lit(0.0)) * 60, 6).alias("per_minute"),
    )
