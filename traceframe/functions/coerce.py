"""Types for text values: sentinels, inference over whole columns, recursive and per-path conversion."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceframe.functions.text import strip

# Dates that stand for "none", and the words read as booleans.
NO_DATE = ("0001-01-01T00:00:00Z", "9999-12-31T23:59:59Z")
TRUE_WORDS = ("true", "yes", "y", "1")
BOOL_WORDS = ("true", "false", "yes", "no", "y", "n", "1", "0")
ORDER = ("timestamp", "bigint", "double", "boolean")
_INT = r"^[+-]?\d+$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_date(text: Column) -> Column:
    """ISO timestamp with a full date; sentinels and anything else are null."""
    value = strip(text)
    full = F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]|$)")) & ~value.isin(*NO_DATE)
    return F.when(full, F.try_to_timestamp(value))


def convert(text: Column, kind: str) -> Column:
    """Value as ``timestamp``, ``bigint``, ``double``, ``boolean`` or trimmed ``string``; null when it does not fit."""
    value = strip(text)
    low = F.lower(value)
    return {
        "timestamp": lambda: parse_date(text),
        "bigint": lambda: F.when(F.rlike(value, F.lit(_INT)), value.try_cast("bigint")),
        "double": lambda: F.when(F.rlike(value, F.lit(_FLOAT)), value.try_cast("double")),
        "boolean": lambda: F.when(low.isin(*BOOL_WORDS), low.isin(*TRUE_WORDS)),
        "string": lambda: value,
    }[kind]()


def _fits(text: Column, kind: str) -> Column:
    return text.isNull() | (strip(text) == "") | convert(text, kind).isNotNull() | (strip(text).isin(*NO_DATE) if kind == "timestamp" else F.lit(False))


def _fitter(kind: str):
    return lambda v: _fits(v, kind)


def _getter(name: str):
    return lambda x: x.getField(name)


def _is_raw(name: str) -> bool:
    return name == "@odata.type" or name.endswith("@odata.context")


def _leaves(column: Column, kind: T.DataType, path: str) -> list[tuple[str, Column, bool]]:
    """Every string leaf below a column as ``(path, value or array of values in this row, is_array)``."""
    if isinstance(kind, T.StringType):
        return [(path, column, False)]
    if isinstance(kind, T.StructType):
        out = []
        for field in kind.fields:
            if not _is_raw(field.name):
                out += _leaves(column.getField(field.name), field.dataType, f"{path}.{field.name}")
        return out
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StringType):
            return [(f"{path}[]", F.coalesce(column, F.array().cast("array<string>")), True)]
        if isinstance(inner, T.StructType):
            out = []
            for field in inner.fields:
                if not _is_raw(field.name):
                    values = F.transform(column, _getter(field.name))
                    out += _leaves_of_array(values, field.dataType, f"{path}[].{field.name}")
            return out
        return _leaves_of_array(column, inner, f"{path}[]")
    return []


def _leaves_of_array(values: Column, kind: T.DataType, path: str) -> list[tuple[str, Column, bool]]:
    if isinstance(kind, T.StringType):
        return [(path, F.coalesce(values, F.array().cast("array<string>")), True)]
    if isinstance(kind, T.StructType):
        out = []
        for field in kind.fields:
            if not _is_raw(field.name):
                out += _leaves_of_array(F.transform(values, _getter(field.name)), field.dataType, f"{path}.{field.name}")
        return out
    if isinstance(kind, T.ArrayType):
        return _leaves_of_array(F.flatten(F.filter(values, lambda x: x.isNotNull())), kind.elementType, f"{path}[]")
    return []


def infer_types(df: DataFrame) -> dict[str, str]:
    """One type per text leaf: the first of timestamp, bigint, double, boolean that every value fits, else string.

    All rows count, in one aggregate of booleans; a single row of flags reaches the driver. A leaf
    without any value stays a string.
    """
    leaves = [leaf for f in df.schema.fields if not _is_raw(f.name) for leaf in _leaves(F.col(f"`{f.name}`"), f.dataType, f.name)]
    if not leaves:
        return {}
    tests = []
    some = lambda v: v.isNotNull() & (strip(v) != "")
    for i, (_, value, is_array) in enumerate(leaves):
        tests.append(F.bool_or(F.exists(value, some) if is_array else some(value)).alias(f"s{i}"))
        for kind in ORDER:
            fits = F.forall(value, _fitter(kind)) if is_array else _fits(value, kind)
            tests.append(F.bool_and(fits).alias(f"{kind}{i}"))
    flags = df.agg(*tests).first()
    types = {}
    for i, (path, _, _) in enumerate(leaves):
        fitting = [k for k in ORDER if flags[f"s{i}"] and flags[f"{k}{i}"]]
        types[path] = fitting[0] if fitting else "string"
    return types


def _rebuild(column: Column, kind: T.DataType, path: str, types: Mapping[str, str]) -> Column:
    if isinstance(kind, T.StringType):
        return convert(column, types.get(path, "string"))
    if isinstance(kind, T.StructType):
        fields = [
            (column.getField(f.name) if _is_raw(f.name) else _rebuild(column.getField(f.name), f.dataType, f"{path}.{f.name}", types)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _rebuild(x, kind.elementType, f"{path}[]", types))
    return column


def coerce(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """Convert text through structs and arrays; keys ``@odata.type`` and ``*@odata.context`` stay as they are."""
    chosen = infer_types(df) if types is None else types
    return df.select(
        *[
            (F.col(f"`{f.name}`") if _is_raw(f.name) else _rebuild(F.col(f"`{f.name}`"), f.dataType, f.name, chosen)).alias(f.name)
            for f in df.schema.fields
        ]
    )


_BY_NAME = {"datetime": "timestamp", "int": "bigint", "float": "double"}


def convert_paths(df: DataFrame, conversions: Mapping[str, str]) -> DataFrame:
    """Explicit conversion of dotted paths to datetime, int, float or bool; unknown paths are ignored.

    ``bool`` is true for true/yes/y/1 and false for any other text.
    """

    def one(value: Column, kind: str) -> Column:
        if kind == "bool":
            return F.lower(value).isin(*TRUE_WORDS)
        return convert(value.cast("string"), _BY_NAME[kind])

    def inside(column: Column, kind: T.DataType, parts: list[str], target: str) -> Column | None:
        if not parts:
            return one(column, target)
        if not isinstance(kind, T.StructType) or parts[0] not in kind.fieldNames():
            return None
        new = inside(column.getField(parts[0]), kind[parts[0]].dataType, parts[1:], target)
        return None if new is None else column.withField(parts[0], new)

    for path, target in conversions.items():
        head, *rest = path.split(".")
        if head in df.columns:
            new = inside(F.col(head), df.schema[head].dataType, rest, target)
            if new is not None:
                df = df.withColumn(head, new)
    return df
