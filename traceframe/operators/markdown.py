"""Markdown tables in text columns as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.functions.text import table_blocks, table_header, table_rows


def table_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, table_no, row_no, column_no, header, value)`` of every markdown table; no shuffle."""
    tables = df.select(key, F.posexplode(table_blocks(F.col(text))).alias("__t", "__block"))
    rows = tables.select(
        key, "__t", table_header(F.col("__block")).alias("__head"), F.posexplode(table_rows(F.col("__block"))).alias("__r", "__cells")
    )
    pairs = F.slice(F.arrays_zip("__head", "__cells"), 1, F.least(F.size("__head"), F.size("__cells")))
    cells = rows.select(key, "__t", "__r", F.posexplode(pairs).alias("__c", "__pair"))
    return cells.select(
        key,
        (F.col("__t") + 1).alias("table_no"),
        (F.col("__r") + 1).alias("row_no"),
        (F.col("__c") + 1).alias("column_no"),
        F.col("__pair.__head").alias("header"),
        F.col("__pair.__cells").alias("value"),
    )
