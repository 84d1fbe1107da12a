"""Ordered computations per key that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so one busy stream or URL
stalls the job. Here each key is cut into *chunks* of consecutive rows:

1. a window over ``(key, chunk)`` computes the local running values,
2. a partial aggregate reduces every chunk to one row,
3. a window over those few rows gives the value each chunk starts with,
4. both are joined on ``(key, chunk)``, which the first window has already hashed by.

Chunks come from the data itself (line numbers, time), so a recomputed task gets the same chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_ROWS = 1 << 16
#: Positions whose values are gathered into one row for :func:`context_before`, at least.
CONTEXT_BLOCK = 64
MICROS = 1_000_000


def number_chunk(number: Column, size: int | None = None) -> Column:
    """Chunk of a unique integer position, named by its first one: at most ``size`` rows by construction."""
    whole = number.cast("long")
    return whole - F.pmod(whole, F.lit(size or CHUNK_ROWS))


def time_chunks(
    df: DataFrame,
    keys: Sequence[str],
    ts: str | Column,
    name: str = "__chunk",
    coarse_seconds: int = 86_400,
    fine_seconds: int = 1,
    limit: int = 5_000_000,
) -> DataFrame:
    """Add a time chunk: the start (in microseconds) of a coarse interval, or of a fine one where
    the coarse interval of this key holds more than ``limit`` rows. ``ts`` is a timestamp column, or a
    Column of microseconds.

    Fine intervals nest in coarse ones, so chunks of both widths order by their start. The list of
    crowded intervals has at most ``rows / limit`` entries; how it is joined is left to Spark, which
    checks its size.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")) if isinstance(ts, str) else ts

    def start(seconds: int) -> Column:
        width = seconds * MICROS
        return (micros - F.pmod(micros, F.lit(width))).cast("long")

    spread = df.withColumn("__wide", start(coarse_seconds))
    crowded = (
        spread.groupBy(*keys, "__wide")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__rows") > limit)
        .select(*[F.col(k).alias(f"__c_{i}") for i, k in enumerate(keys)], F.col("__wide").alias("__c_wide"))
    )
    same = F.col("__wide") == F.col("__c_wide")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"__c_{i}"))
    helper = ["__wide", "__c_wide", *[f"__c_{i}" for i in range(len(keys))]]
    return (
        spread.join(crowded, same, "left")
        .withColumn(name, F.when(F.col("__c_wide").isNotNull(), start(fine_seconds)).otherwise(F.col("__wide")))
        .drop(*helper)
    )


def _null_safe(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Non-null stand-ins for the keys, so windows and joins hash alike and null keys survive."""
    names: list[str] = []
    for i, key in enumerate(keys):
        kind = df.schema[key].dataType
        if isinstance(kind, T.StringType):
            neutral = F.lit("")
        elif isinstance(kind, T.NumericType):
            neutral = F.lit(0).cast(kind)
        else:
            df = df.withColumn(f"__k{i}", F.coalesce(F.col(key).cast("string"), F.lit("")))
            neutral = None
        if neutral is not None:
            df = df.withColumn(f"__k{i}", F.coalesce(F.col(key), neutral))
        df = df.withColumn(f"__n{i}", F.col(key).isNull())
        names += [f"__k{i}", f"__n{i}"]
    return df, names


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running values per key in ``order`` (which must be total within a key).

    * ``sums`` – inclusive running sum of the column,
    * ``last`` – last non-null value strictly before the row,
    * ``next`` – first non-null value strictly after the row.
    """
    sums, last, next = dict(sums or {}), dict(last or {}), dict(next or {})
    # rows without a position sort first, as nulls do, and must not get lost in the join on the chunk
    base, stand_ins = _null_safe(df.withColumn(chunk, F.coalesce(chunk, F.lit(-(1 << 63)))), keys)
    for kind, columns in (("s", sums), ("l", last), ("n", next)):
        for name, value in columns.items():
            base = base.withColumn(f"__{kind}_{name}", value)
    group = [*stand_ins, chunk]
    # one plain column keeps the chunk summary a hash aggregate; a struct would make it sort its input
    position = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])

    ahead = Window.partitionBy(*group).orderBy(*[F.col(c).asc() for c in order])
    back = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    before = (Window.unboundedPreceding, -1)
    local = base.select(
        "*",
        *[F.sum(f"__s_{n}").over(ahead.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__ls_{n}") for n in sums],
        *[F.last(f"__l_{n}", ignorenulls=True).over(ahead.rowsBetween(*before)).alias(f"__ll_{n}") for n in last],
        # the row after, read backwards: an unbounded-following frame would rescan the chunk per row
        *[F.last(f"__n_{n}", ignorenulls=True).over(back.rowsBetween(*before)).alias(f"__ln_{n}") for n in next],
    )

    known = lambda c: F.when(F.col(c).isNotNull(), position)
    summary = base.groupBy(*group).agg(
        *[F.sum(f"__s_{n}").alias(f"__ts_{n}") for n in sums],
        *[F.max_by(F.col(f"__l_{n}"), known(f"__l_{n}")).alias(f"__tl_{n}") for n in last],
        *[F.min_by(F.col(f"__n_{n}"), known(f"__n_{n}")).alias(f"__tn_{n}") for n in next],
    )
    across = Window.partitionBy(*stand_ins).orderBy(F.col(chunk).asc()).rowsBetween(*before)
    across_back = Window.partitionBy(*stand_ins).orderBy(F.col(chunk).desc()).rowsBetween(*before)
    carried = summary.select(
        *group,
        *[F.sum(f"__ts_{n}").over(across).alias(f"__cs_{n}") for n in sums],
        *[F.last(f"__tl_{n}", ignorenulls=True).over(across).alias(f"__cl_{n}") for n in last],
        *[F.last(f"__tn_{n}", ignorenulls=True).over(across_back).alias(f"__cn_{n}") for n in next],
    )
    joined = local.join(carried, group)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"__ls_{n}"), F.lit(0)) + F.coalesce(F.col(f"__cs_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
        *[F.coalesce(F.col(f"__ll_{n}"), F.col(f"__cl_{n}")).alias(n) for n in last],
        *[F.coalesce(F.col(f"__ln_{n}"), F.col(f"__cn_{n}")).alias(n) for n in next],
    )


def join_one_per_key(big: DataFrame, small: DataFrame, keys: Sequence[str], by: str, salts: int = 32) -> DataFrame:
    """Left join with a frame of at most one row per key, where one key may hold most rows of ``big``.

    The small side is repeated once per salt and the big side is spread by a hash of ``by``, so a
    busy key is joined by ``salts`` tasks. It does not lean on runtime skew handling, which is off inside
    streaming batches.
    """
    left, stand_ins = _null_safe(big, keys)
    right, _ = _null_safe(small, keys)
    extra = [c for c in small.columns if c not in keys]
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("__salt")
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts).cast("long")))
    return salted.join(right.select(*stand_ins, *extra, copies), [*stand_ins, "__salt"], "left").select(*big.columns, *extra)


def number_rows(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], name: str) -> DataFrame:
    """Dense 1-based position per key."""
    return ordered_scan(df, keys, chunk, order, sums={name: F.lit(1).cast("long")})


def last_rows(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, n: int, name: str, size: int | None = None
) -> DataFrame:
    """The last ``n`` values up to and including each row, as an array.

    ``position`` is dense, so chunk ``c`` needs only the last ``n - 1`` rows of ``c - 1``: those rows
    are sent to both chunks and every window group has at most ``size + n - 1`` rows.
    """
    size = size or max(CHUNK_ROWS, n)
    if size < n - 1:
        raise ValueError(f"a chunk of {size} rows is shorter than the {n} rows looked back")
    base, stand_ins = _null_safe(df.withColumn("__value", value), keys)
    own = F.floor((F.col(position) - 1) / F.lit(size)).cast("long")
    tail = F.col(position) > (F.col("__own") + 1) * size - (n - 1)
    spread = base.withColumn("__own", own).withColumn(
        "__at", F.explode(F.when(tail, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own")))
    )
    frame = Window.partitionBy(*stand_ins, "__at").orderBy(position).rowsBetween(-(n - 1), 0)
    return (
        spread.withColumn(name, F.collect_list("__value").over(frame))
        .where(F.col("__at") == F.col("__own"))
        .select(*df.columns, name)
    )


def context_before(
    hits: DataFrame, rows: DataFrame, keys: Sequence[str], position: str, value: Column, n: int, name: str
) -> DataFrame:
    """Attach the last ``n`` values up to and including each hit, in one aggregation and one join; null where there is none.

    Values are gathered by blocks of positions, the last ``n - 1`` of a block also into the next one. So a hit meets
    one row, the block of its position, and cuts its values out of that; a block has at most ``size + n - 1`` values.
    """
    size = max(CONTEXT_BLOCK, n)
    own = F.floor((F.col(position) - 1) / F.lit(size)).cast("long")
    tail = F.col(position) > (own + 1) * size - (n - 1)
    at = F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))).alias("__block")
    pair = F.struct(F.col(position).alias("p"), value.alias("v")).alias("__pair")
    blocks = rows.select(*keys, pair, at).groupBy(*keys, "__block").agg(F.sort_array(F.collect_list("__pair")).alias("__pairs"))
    near = F.filter("__pairs", lambda x: x["p"].between(F.col(position) - (n - 1), F.col(position)))
    found = hits.withColumn("__block", own).join(blocks.hint("merge"), [*keys, "__block"], "left").withColumn("__near", near)
    context = F.when(F.size("__near") > 0, F.transform("__near", lambda x: x["v"]))
    return found.select(*keys, position, *[c for c in hits.columns if c not in (*keys, position)], context.alias(name))


def trailing_counts(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    seconds: int,
    name: str,
    chunk_seconds: int = 3_600,
    fine_seconds: int = 1,
    limit: int = 5_000_000,
) -> DataFrame:
    """Events of the same key in ``(ts - seconds, ts]`` for every event; equal times are peers.

    An event without a time is in no window and counts as null.

    Events first shrink to one row per distinct time. With ``C(t)`` the running count of the key, the
    answer is ``C(ts) - C(ts - seconds)``; both are read off one chunked running sum over the
    times and their shifted copies, so neither a long window nor a busy key fills one task.
    """
    moments = events.where(F.col(ts).isNotNull()).groupBy(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    step = lambda at, n, sign: F.struct(at.alias("at"), n.alias("n"), F.lit(sign).alias("sign"))
    steps = moments.select(
        *keys,
        F.col("__at").alias("__moment"),
        F.explode(
            F.array(
                step(F.col("__at"), F.col("__n"), 1),
                step(F.col("__at") - seconds * MICROS, F.lit(0).cast("long"), -1),
            )
        ).alias("step"),
    ).select(
        *keys,
        "__moment",
        F.col("step.at").alias("__pos"),
        F.col("step.n").alias("__add"),
        F.col("step.sign").alias("__sign"),
        # at one position the events come first, so an event exactly ``seconds`` old is outside
        (-F.col("step.sign")).alias("__rank"),
    )
    steps = time_chunks(steps, keys, F.col("__pos"), "__chunk", chunk_seconds, fine_seconds, limit)
    running = ordered_scan(steps, keys, "__chunk", ["__pos", "__rank"], sums={"__c": F.col("__add")})
    counts = running.groupBy(*keys, "__moment").agg(F.sum(F.col("__sign") * F.col("__c")).alias(name))
    base, stand_ins = _null_safe(
        events.withColumn("__moment", F.unix_micros(F.col(ts).cast("timestamp"))), keys
    )
    counts, _ = _null_safe(counts, keys)
    return base.join(counts.select(*stand_ins, "__moment", name), [*stand_ins, "__moment"], "left").select(
        *events.columns, name
    )
