"""Conversation turns: tool intent, tool label, token totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.operators.logs import any_of
from traceframe.operators.ordered import number_chunk, ordered_scan

# Phrases that announce a tool call, and the words that choose its label (first row wins).
INTENT_PHRASES = (
    "let me get", "let me check", "let me examine", "let me look at", "let me see", "let me find", "let me search",
    "let me preview", "i need to get", "i need to check", "i need to examine", "i need to look at", "i need to see",
    "i want to get", "i want to check", "i want to examine", "i want to look at", "i want to see", "i should get",
    "i should check", "i should examine", "i should look at", "by previewing", "by examining", "by checking", "by getting",
)
TOOL_WORDS = (
    (("preview", "look at", "examine", "see", "show"), "preview_code"),
    (("search", "find", "grep", "pattern"), "grep_content"),
    (("list", "files", "directory"), "list_files"),
    (("function", "calls", "usage"), "find_calls"),
    (("summary", "overview"), "get_repo_summary"),
)
DEFAULT_TOOL = "preview_code"


def suggests_tool(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(any_of([low.contains(p) for p in INTENT_PHRASES]), F.lit(False))


def tool_label(text: Column) -> Column:
    """First matching label, a default otherwise, empty for no text."""
    low = F.lower(text)
    label = F.when(text.isNull() | (text == ""), "")
    for words, name in TOOL_WORDS:
        label = label.when(any_of([low.contains(w) for w in words]), name)
    return label.otherwise(DEFAULT_TOOL)


def token_totals(usage: DataFrame) -> DataFrame:
    """Input, output and total tokens and iterations per conversation."""
    return usage.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("long").alias("total_tokens"),
    )


def running_tokens(usage: DataFrame) -> DataFrame:
    """Cumulative tokens after each iteration."""
    chunked = usage.withColumn("__chunk", number_chunk(F.col("iteration")))
    sums = {"input_so_far": F.col("input_tokens").cast("long"), "output_so_far": F.col("output_tokens").cast("long")}
    return ordered_scan(chunked, ["conv_id"], "__chunk", ["iteration"], sums=sums).drop("__chunk")
