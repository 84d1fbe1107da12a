"""Record sources: check results, nested JSON tables, the table catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from traceframe.operators.checks import BODY_CHARS

CHECK_SCHEMA = (
    "check_id bigint, url string, ts timestamp, attempt int, method string, status int, error_type string, error string, body string"
)


def scan_checks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Check attempts from JSON lines with a fixed schema (no inference pass)."""
    return spark.read.schema(CHECK_SCHEMA).json(path)


def check_failures(attempts: DataFrame) -> DataFrame:
    """Failure records; the body keeps its first 1000 characters."""
    known = {"error": "exception", "error_type": "exception_type", "status": "response_status"}
    renamed = attempts.where(F.col("error_type").isNotNull()).withColumnsRenamed(known)
    return renamed.withColumn("response_body", F.substring("body", 1, BODY_CHARS)).drop("body")


def sampled_schema(spark: SparkSession, path: str | list[str], rows: int | None = None) -> T.StructType:
    """Schema of nested JSON from all of its records (one distributed pass); with ``rows`` from that many first ones.

    A missing or empty source gives an empty schema; any other error is raised.
    """
    try:
        if rows is None:
            return spark.read.json(path).schema
        head = [r.value for r in spark.read.text(path).where(F.trim("value") != "").limit(rows).collect()]
        return spark.read.json(spark.sparkContext.parallelize(head, 1)).schema if head else T.StructType([])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return T.StructType([])


def scan_nested(
    spark: SparkSession, mailboxes: Mapping[str, str], schema: T.StructType | None = None, limit: int | None = None
) -> DataFrame:
    """Nested JSON of many mailboxes in one frame, tagged with ``mailbox``; all branches share one schema."""
    shape = schema if schema is not None else sampled_schema(spark, list(mailboxes.values()))
    parts = [
        spark.read.schema(shape).json(path).withColumn("mailbox", F.lit(name)) for name, path in mailboxes.items()
    ]
    merged = reduce(lambda a, b: a.unionByName(b), parts)
    return merged.limit(limit) if limit is not None else merged


class Catalog:
    """Named tables over temp views: list them, get one, fail clearly on an unknown name."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self._spark = spark
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def names(self) -> list[str]:
        return sorted(t.name for t in self._spark.catalog.listTables())

    def table(self, name: str) -> DataFrame:
        if name not in self.names():
            raise KeyError(f"no table {name!r}; known: {', '.join(self.names())}")
        return self._spark.table(name)


def project(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by a mapping of output name to (possibly nested) source field."""
    return df.select(*[F.col(source).alias(name) for name, source in mapping.items()])


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Merge scans by column name; order is not kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def per_item(df: DataFrame, generate: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Rows a user generator yields for each item (none, one or many); items stay spread as they are."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fieldNames()

    def work(batches):
        for batch in batches:
            rows = [row for item in batch.to_pylist() for row in generate(item)]
            yield pa.RecordBatch.from_pydict({f: [r.get(f) for r in rows] for f in fields}, schema=arrow)

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(work, schema)


def with_generated(df: DataFrame, generate: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Each item beside the rows that a user generator yields for it: a Python table function in a lateral join.

    The generator sees the item's columns; its own must not repeat their names. An item without rows is left
    out (Spark drops it in a left lateral join too). Items stay spread as they are: nothing is grouped or shuffled.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema.fieldNames()
    if twice := set(fields) & set(df.columns):
        raise ValueError(f"columns of the items are generated again: {sorted(twice)}")

    class Generated:
        def eval(self, item):
            for row in generate(item.asDict(recursive=True)):
                yield tuple(row.get(f) for f in fields)

    table_function = F.udtf(Generated, returnType=schema)
    item = F.struct(*[F.col(c).outer() for c in df.columns])
    return df.lateralJoin(table_function(item))
