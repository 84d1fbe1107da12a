"""File checks: syntax, user checks, per-file summaries, issues near changed lines."""

from __future__ import annotations

import ast
import time
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.functions.text import line_number
from traceframe.operators.logs import evaluate_once
from traceframe.operators.search import LINE_BUCKET

RESULT = (
    "file string, check_type string, success boolean, messages array<string>, warnings array<string>, errors array<string>, "
    "line bigint, col bigint, message string, execution_time double"
)
_TEXTS = pa.list_(pa.string())
_ARROW = pa.schema(
    [
        ("file", pa.string()), ("check_type", pa.string()), ("success", pa.bool_()), ("messages", _TEXTS), ("warnings", _TEXTS),
        ("errors", _TEXTS), ("line", pa.int64()), ("col", pa.int64()), ("message", pa.string()), ("execution_time", pa.float64()),
    ]
)
TOLERANCE = 2

Check = Callable[[str, str], dict | None]


def outcome(success: bool, messages=(), warnings=(), errors=(), line=None, col=None, message=None) -> dict:
    """Result of a check on one file; a check returns None for a file it does not handle."""
    return {
        "success": success, "messages": list(messages), "warnings": list(warnings), "errors": list(errors),
        "line": line, "col": col, "message": message,
    }


def python_syntax(path: str, text: str) -> dict | None:
    if not path.endswith(".py"):
        return None
    try:
        ast.parse(text)
        return outcome(True)
    except (SyntaxError, ValueError) as error:
        line, message = getattr(error, "lineno", None), getattr(error, "msg", None) or str(error)
        return outcome(False, errors=[f"Line {line}: {message}"], line=line, col=getattr(error, "offset", None), message=message)


def run_checks(files: DataFrame, checks: Mapping[str, Check], path: str = "path", text: str = "text") -> DataFrame:
    """Run every check on every file, in parallel over files; one row per applicable check.

    A check that raises gives a failed row and the job goes on.
    """
    registry = dict(checks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, check in registry.items():
                    begin = time.perf_counter()
                    try:
                        result = check(name, body or "")
                    except Exception as error:  # noqa: BLE001 - a broken check must not end the job
                        result = outcome(False, [f"check {kind} failed"], errors=[f"Internal error: {error}"])
                    if result is not None:
                        rows.append({"file": name, "check_type": kind, "execution_time": time.perf_counter() - begin, **result})
            yield from pa.Table.from_pylist(rows, schema=_ARROW).to_batches()

    return files.select(path, text).mapInArrow(work, RESULT)


def syntax_check(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    return run_checks(files, {"syntax": python_syntax}, path, text)


def summarize(results: DataFrame) -> DataFrame:
    """Checks, passes, failures, warnings and errors per file, and whether all passed."""
    total = lambda c: F.sum(F.size(c)).cast("long")
    return results.groupBy("file").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("passed"),
        F.count_if(~F.col("success")).alias("failed"),
        total("warnings").alias("warnings"),
        total("errors").alias("errors"),
        F.bool_and("success").alias("overall"),
    )


def near_changes(issues: DataFrame, changed: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Issues within ``tolerance`` lines of a changed line of their file; issues naming no line stay.

    Changed lines are gathered by buckets of 64 lines that they reach, so the band is an equality join with at most
    ``64 + 2 * tolerance`` lines a row, and the issues are read a single time. Both sides are shuffled: Spark sizes the
    gathered lines by the table they come from, and would send far more rows to every task than it believes.
    """
    placed = evaluate_once(issues, F.struct(line_number(F.col("message")).alias("line")))
    at = F.col("line").cast("long")
    bucket = lambda line: F.floor(line / LINE_BUCKET)
    reached = changed.select("file", at.alias("__line"), F.explode(F.sequence(bucket(at - tolerance), bucket(at + tolerance))).alias("__bucket"))
    lines = reached.groupBy("file", "__bucket").agg(F.collect_set("__line").alias("__lines"))
    near = F.exists("__lines", lambda line: F.abs(line - at) <= tolerance)
    found = placed.withColumn("__bucket", bucket(at)).join(lines.hint("merge"), ["file", "__bucket"], "left")
    return found.where(near | F.col("line").isNull()).select(*placed.columns)
