"""Line sources: text files, text columns, and several streams merged into one."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_SCHEMA = T.StructType([T.StructField("value", T.StringType())])
# whitespace that makes a line blank
BLANK = " \t\n\r\u000b\u000c"
# the folder that a file is in, without its ``name=``; and a time at the start of a line
FOLDER = r"(?:^|/)(?:[^/=]*=)?([^/]+)/[^/]*$"
LEADING_TIME = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?)[ \t](.*)$"


def _not_blank(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK)) != ""


def scan_lines(spark: SparkSession, path: str | list[str], line_sep: str = "\n") -> DataFrame:
    """Non-blank lines of text files with the file and a per-file 1-based ``line_no``.

    Spark splits a large file into blocks read by different tasks. Within a block the row id grows
    with the line; blocks are ordered by their byte offset. So a line's number is its place in the
    block plus the lines of the blocks before it. Only one summary row per block is windowed; the
    lines themselves are not sorted. Undecodable bytes become the replacement character.
    """
    raw = spark.read.text(path, lineSep=line_sep).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.col("value").alias("line"),
    )
    rows = raw.where(_not_blank(F.col("line"))).withColumn("__id", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "file", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    return rows.join(starts, ["file", "__block"]).select(
        "file", (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("line_no"), "line"
    )


def stream_lines(spark: SparkSession, path: str, line_sep: str = "\n", max_files: int | None = None, stream: str = FOLDER, time: str = LEADING_TIME) -> DataFrame:
    """Streaming form: non-blank lines of the files that arrive in a folder, with stream id, place and event time.

    Columns: file, ingest_ts, line, stream_id (group 1 of ``stream`` in the file's path, the folder unless told otherwise; the
    path itself where it does not match), file_ts (last change of the file), block (where its block begins), ts. Where a
    line begins with a time (group 1 of ``time``), that is the event time and the rest (group 2) the line; else the event
    time is the file's. :func:`place_lines` numbers the lines of a micro-batch.
    """
    reader = spark.readStream.schema(LINE_SCHEMA).option("lineSep", line_sep)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    file = F.col("_metadata.file_path")
    found, dated = F.regexp_extract(file, stream, 1), F.rlike(F.col("value"), F.lit(time))
    stamp = F.when(dated, F.translate(F.regexp_extract("value", time, 1), ",", ".").try_cast("timestamp"))
    return (
        reader.format("text")
        .load(path)
        .select(
            file.alias("file"),
            F.current_timestamp().alias("ingest_ts"),
            F.when(stamp.isNotNull(), F.regexp_extract("value", time, 2)).otherwise(F.col("value")).alias("line"),
            F.when(found != "", found).otherwise(file).alias("stream_id"),
            F.col("_metadata.file_modification_time").alias("file_ts"),
            F.col("_metadata.file_block_start").alias("block"),
            F.coalesce(stamp, F.col("_metadata.file_modification_time")).alias("ts"),
        )
        .where(_not_blank(F.col("line")))
    )


def place_lines(batch: DataFrame, files: Sequence[str] = ("file",)) -> DataFrame:
    """Number the lines of one micro-batch of :func:`stream_lines`: ``line_no`` from 1 in each stream of the batch.

    Files of a stream follow one another in the order of ``files`` (their path; ``("file_ts", "file")`` for that of their
    changes). As in :func:`scan_lines`, row ids grow with the lines of a block and only one row a block is windowed. Files are
    taken whole by one micro-batch, so the lines before a batch are one count a stream, which the caller carries.
    """
    rows = batch.withColumn("__id", F.monotonically_increasing_id())
    blocks = rows.groupBy("stream_id", *dict.fromkeys((*files, "file")), "block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("stream_id").orderBy(*files, "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(starts, ["file", "block"]).withColumn("line_no", F.col("__id") - F.col("__first") + F.col("__before") + 1).drop("__id", "__first", "__before")


def lines_of_text(df: DataFrame, text: str, line_sep: str = "\n") -> DataFrame:
    """Explode a text column into its non-blank lines, numbered after blanks are dropped.

    Numbering happens inside the row's own array, so no shuffle and no window are needed.
    """
    kept = F.filter(F.split(F.col(text), re.escape(line_sep), -1), _not_blank)
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(kept).alias("__pos", "line")).select(
        *others, (F.col("__pos") + 1).cast("long").alias("line_no"), "line"
    )


def split_lines(df: DataFrame, text: str, mode: str = "newline") -> DataFrame:
    """Explode a text column into numbered lines (``line_no`` 1-based, blanks kept).

    ``newline`` splits on LF and keeps a last empty line; ``splitlines`` also splits on CR, CRLF and
    the other line separators, and drops one trailing empty line.
    """
    others = [c for c in df.columns if c != text]
    if mode == "newline":
        parts = F.split(F.col(text), "\n", -1)
    elif mode == "splitlines":
        unified = F.regexp_replace(F.col(text), "\r\n|[\r\u000b\u000c\u001c\u001d\u001e\u0085  ]", "\n")
        whole = F.split(unified, "\n", -1)
        parts = F.when(F.element_at(whole, -1) == "", F.slice(whole, 1, F.size(whole) - 1)).otherwise(whole)
    else:
        raise ValueError(f"unknown line mode {mode!r}")
    return df.select(*others, F.posexplode(parts).alias("__pos", "line")).select(
        *others, (F.col("__pos") + 1).cast("long").alias("line_no"), "line"
    )


def fan_in(streams: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """Merge streams (batch or streaming), each row tagged with its stream id and URL."""
    tagged = [
        df.select(F.lit(stream_id).alias("stream_id"), F.lit(url).alias("url"), "*") for stream_id, (url, df) in streams.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
