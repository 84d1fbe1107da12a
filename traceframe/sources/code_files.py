"""Source-file scan and decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.functions.globs import excluded


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1 (which accepts any byte)."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def scan_files(
    spark: SparkSession,
    root: str,
    glob: str = "*.py",
    recursive: bool = True,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """``(path, content, text)`` of matching files below ``root``; excluded paths are never decoded."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    raw = reader.option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace("path", f"^.*?{_quoted(base)}/", "")
    kept = raw.select(relative.alias("path"), "content").where(~excluded(F.col("path"), exclude))
    return kept.withColumn("text", decode_text(F.col("content")))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
