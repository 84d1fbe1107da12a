"""HTML text and tables. A standard-library parser reads one document; Spark spreads the documents."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceframe.functions.text import hyperlink

# Elements that end a line of text, and elements whose content is not text.
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre",
    "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
HIDDEN = ("script", "style")


def _feed(make, html: str):
    """Parse a document. The parser gives up on unknown ``<![`` sections; those are then read as text."""
    parser = make()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:
        parser = make()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    return parser


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def plain_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _feed(_Text, html)
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """Visible text, one line per block, blanks collapsed."""
    return html.map(plain_text, na_action="ignore")


class _Rows(HTMLParser):
    """Rows of the first table: ``(class, is_header, cells)``; ``th`` and ``td`` heads both count."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, bool, list[str]]] = []
        self.depth, self.done, self.in_head, self.cell, self.row = 0, False, False, None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if self.done or self.depth != 1:
            return
        if tag == "thead":
            self.in_head = True
        elif tag == "tr":
            self.row = [dict(attrs).get("class") or "", self.in_head, []]
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []
            self.row[1] = self.row[1] or (tag == "th" and not self.rows)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.done or self.depth == 0
        if self.depth != 1 or self.done:
            return
        if tag == "thead":
            self.in_head = False
        elif tag in ("td", "th") and self.cell is not None:
            self.row[2].append("".join(self.cell).strip())
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(tuple(self.row))
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


_ARROW = pa.schema(
    [("key", pa.string()), ("row_no", pa.int32()), ("row_class", pa.string()), ("header", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))]
)


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parser = _feed(_Rows, html or "")
            header = next((cells for _, head, cells in parser.rows if head), [])
            body = [r for r in parser.rows if not r[1]]
            rows += [{"key": key, "row_no": i, "row_class": c, "header": header, "cells": cells} for i, (c, _, cells) in enumerate(body, 1)]
        yield from pa.Table.from_pylist(rows, schema=_ARROW).to_batches()


def table_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Body rows of each page's first table with the header cells: ``(key, row_no, row_class, header, cells)``."""
    rows = pages.select(F.col(key).cast("string").alias("key"), html).mapInArrow(
        _table_rows, "key string, row_no int, row_class string, header array<string>, cells array<string>"
    )
    return rows.withColumnRenamed("key", key)


def named_cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """Header zip row: one column per wanted header name, null where a row is short."""
    value = lambda n: F.get("cells", F.array_position("header", n).cast("int") - 1)
    return rows.select("*", *[F.when(F.array_contains("header", n), value(n)).alias(n) for n in names])


def technique_rows(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows with ids completed: a sub row drops its empty first cell and prepends the id of the last parent row.

    The fill runs within one page's table.
    """
    is_sub = F.array_contains(F.split("row_class", r"\s+"), "sub")
    page = Window.partitionBy(key).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    parent = F.last(F.when(~is_sub, F.get("cells", F.lit(0))), ignorenulls=True).over(page)
    shifted = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    filled = rows.withColumn("__parent", parent).withColumn("cells", F.when(is_sub, shifted).otherwise(F.col("cells")))
    named = named_cells(filled, ["ID", "Name", "Description"])
    full = F.when(is_sub, F.concat("__parent", "ID")).otherwise(F.col("ID"))
    return named.select(
        key, "row_no", full.alias("id"), F.col("Name").alias("name"), F.col("Description").alias("description"), hyperlink(prefix, full).alias("hyperlink")
    )


def expand_parents(parents: DataFrame, pages: DataFrame, key: str, prefix: str, html: str = "html") -> DataFrame:
    """Technique rows of the page of every parent id."""
    found = pages.join(parents.select(key).distinct(), key, "left_semi")
    return technique_rows(table_rows(found, key, html), key, prefix)
