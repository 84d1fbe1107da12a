"""Vector code compression with adaptive bounds: product codes whose codebooks are refined without comparing every entry again.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook of ``entries`` vectors. Instead
of comparing a part with every entry in each round, a part's state (Drake and Hamerly 2012) is written down: its entry, the
b entries that are next, each with a lower bound of its distance, and one outer bound for all others. When the entries have
moved, bounds move by as much. Entries whose bound is beyond the part's own distance cannot be nearer: with the first such
bound at place i only the i entries before it are compared again, and only where even the outer bound fails are all of them.
b is adapted from round to round to how many places parts had to look at. All comparisons that bounds leave open are made in
whole numbers, so assignments are exact, ties included.

A round is one scan of the written state and one grouped sum of a few thousand rows, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import cut_lineage, discard, query, table

#: Components beyond this magnitude (after scaling) are not coded: squared distances must fit 64 bits.
LARGEST = 1 << 26
#: Share of the parts that may have to look beyond the stored entries when b is chosen.
BEYOND = 0.01
#: Vectors that one numpy pass holds.
ROWS = 1024
#: Relative allowance for rounding; a case within it is verified in whole numbers.
SLIP = 1e-9


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) of whole numbers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        step = x[:, i, None] - entries[None, :, i]
        out += step * step
    return out


def _stored(bounds: np.ndarray) -> np.ndarray:
    """Lower bounds in two bytes, rounded down; a negative one says no more than 0."""
    short = np.minimum(np.maximum(bounds, 0), 60_000).astype(np.float16)
    return np.maximum(np.nextafter(short, np.float16(-1)), np.float16(0))


class Book:
    """Codebooks of all part positions, and how far their entries have moved in the last round."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.moved = np.sqrt(((entries - (entries if before is None else before)).astype(np.float64) ** 2).sum(2)) * (1 + SLIP)

    def compare_all(self, x: np.ndarray, part: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The b + 1 nearest entries (ties by index), the exact squared distance of the first, and b + 1 lower bounds."""
        d = _distances(x, self.entries[part])
        order = np.argsort(d, 1, kind="stable")
        ranked = np.take_along_axis(d, order, 1)
        k = d.shape[1]
        bounds = np.full((len(x), b + 1), np.inf)
        bounds[:, : min(b + 1, k - 1)] = np.sqrt(ranked[:, 1 : b + 2].astype(np.float64)) * (1 - SLIP)
        return order[:, : b + 1].astype(np.uint8), ranked[:, 0], bounds

    def reassign(self, x: np.ndarray, part: int, near: np.ndarray, bounds: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New state for parts with the state (near, bounds) under the entries before they moved, and how deep each had to look.

        near: (rows, b' + 1), own entry first; bounds: (rows, b' + 1), for each further entry and, last, for all others.
        """
        rows, held = len(x), near.shape[1] - 1
        entries, moved = self.entries[part], self.moved[part]
        own = entries[near[:, 0].astype(np.int64)]
        exact = ((x - own) ** 2).sum(1)
        upper = np.sqrt(exact.astype(np.float64))
        lower = bounds.copy()
        lower[:, :held] -= moved[near[:, 1:].astype(np.int64)]
        lower[:, held] -= moved.max()
        # ordered: a bound holds for its entry and all further ones
        lower = np.minimum.accumulate(lower[:, ::-1], 1)[:, ::-1]
        lower -= SLIP * np.abs(np.where(np.isfinite(lower), lower, 0))
        clear = lower > (upper * (1 + SLIP))[:, None]
        depth = np.where(clear.any(1), clear.argmax(1), held + 1)
        out_near = np.zeros((rows, b + 1), np.uint8)
        out_bounds = np.zeros((rows, b + 1))
        kept = min(b, held)
        fits = depth <= held
        # places beyond what was stored repeat the own entry; the outer bound holds there, too
        out_near[:] = near[:, :1]
        out_near[:, : kept + 1] = near[:, : kept + 1]
        out_bounds[:, :kept] = lower[:, :kept]
        out_bounds[:, kept:] = lower[:, kept, None]
        # uncertain: the entries before the first clear bound are compared in whole numbers
        for deep in np.unique(depth[fits & (depth > 0)]):
            at = np.flatnonzero(fits & (depth == deep))
            few = near[at, : deep + 1].astype(np.int64)
            d = ((x[at][:, None, :] - entries[few]) ** 2).sum(2)
            order = np.lexsort((few, d), axis=1)
            few, d = np.take_along_axis(few, order, 1), np.take_along_axis(d, order, 1)
            exact[at] = d[:, 0]
            merged, limits = near[at].copy(), lower[at].copy()
            merged[:, : deep + 1] = few
            limits[:, :deep] = np.sqrt(d[:, 1:].astype(np.float64)) * (1 - SLIP)
            out_near[at] = merged[:, :1]
            out_near[at, : kept + 1] = merged[:, : kept + 1]
            # an entry that is no longer stored is one of the others
            limits = np.minimum.accumulate(limits[:, ::-1], 1)[:, ::-1]
            out_bounds[at, :kept] = limits[:, :kept]
            out_bounds[at, kept:] = limits[:, kept, None]
        at = np.flatnonzero(~fits)
        if len(at):
            out_near[at], exact[at], out_bounds[at] = self.compare_all(x[at], part, b)
        return out_near, exact, out_bounds, np.minimum(depth, held + 1)


def _assign(rows: DataFrame, book: Book, b: int, state: bool, label: str, final: bool) -> DataFrame:
    """One round over all vectors: (vec_id, label, v) with, unless final, the new state, else code and error.

    state: whether the rows carry the state of the round before.
    """
    sent = rows.sparkSession.sparkContext.broadcast(book)
    parts, entries, width = book.entries.shape
    b = min(b, entries - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part = batch.slice(first, ROWS)
                n = len(part)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, width)
                if state:
                    held = part.column("b")[0].as_py()
                    near = np.frombuffer(b"".join(part.column("near").to_pylist()), np.uint8).reshape(n, parts, held + 1)
                    bounds = np.frombuffer(b"".join(part.column("bounds").to_pylist()), np.float16).astype(np.float64).reshape(n, parts, held + 1)
                new_near, new_bounds = np.zeros((n, parts, b + 1), np.uint8), np.zeros((n, parts, b + 1))
                exact, depth = np.zeros((n, parts), np.int64), np.full((n, parts), entries, np.int64)
                for p in range(parts):
                    if state:
                        new_near[:, p], exact[:, p], new_bounds[:, p], depth[:, p] = books.reassign(x[:, p], p, near[:, p], bounds[:, p], b)
                    else:
                        new_near[:, p], exact[:, p], new_bounds[:, p] = books.compare_all(x[:, p], p, b)
                columns = [part.column("vec_id"), part.column(label)]
                if final:
                    code = new_near[:, :, 0].tobytes().hex()
                    size = 2 * parts
                    columns += [pa.array([code[i * size : (i + 1) * size] for i in range(n)], pa.string()), pa.array(exact.sum(1))]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", label, "code", "error"])
                    continue
                columns += [part.column("v"), pa.array(np.full(n, b, np.int32)), pa.array([x.tobytes() for x in new_near], pa.binary()), pa.array([x.tobytes() for x in _stored(new_bounds)], pa.binary()), pa.array([x.tobytes() for x in np.minimum(depth, 255).astype(np.uint8)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", label, "v", "b", "near", "bounds", "depth"])

    kind = rows.schema[label].dataType.simpleString()
    head = f"vec_id bigint, `{label}` {kind}, "
    return rows.mapInArrow(run, head + ("code string, error bigint" if final else "v array<bigint>, b int, near binary, bounds binary, depth binary"))


def _sums(state: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of each (part, entry), their sums by component, and how many parts looked how deep."""
    cells = parts * entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, deep = np.zeros(cells, np.int64), np.zeros((cells, width), np.int64), np.zeros(257, np.int64)
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part = batch.slice(first, ROWS)
                n = len(part)
                held = part.column("b")[0].as_py()
                own = np.frombuffer(b"".join(part.column("near").to_pylist()), np.uint8).reshape(n, parts, held + 1)[:, :, 0]
                cell = (own.astype(np.int64) + np.arange(parts)[None, :] * entries).ravel()
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
                count += np.bincount(cell, minlength=cells)
                for i in range(width):  # sums of 1024 components below 2**26 are exact in doubles
                    total[:, i] += np.bincount(cell, weights=x[:, i], minlength=cells).astype(np.int64)
                deep += np.bincount(np.frombuffer(b"".join(part.column("depth").to_pylist()), np.uint8), minlength=257)
        amounts = np.concatenate([count, total.ravel(), deep])
        slots = np.flatnonzero(amounts)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(amounts[slots])], names=["slot", "amount"])

    amounts = np.zeros(cells * (1 + width) + 257, np.int64)
    for r in state.select("b", "near", "v", "depth").mapInArrow(run, "slot int, amount bigint").groupBy("slot").agg(F.sum("amount").alias("amount")).collect():
        amounts[r["slot"]] = r["amount"]
    return amounts[:cells].reshape(parts, entries), amounts[cells : cells * (1 + width)].reshape(parts, entries, width), amounts[cells * (1 + width) :]


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: one row for each vector without null or non-finite component.

    Codebooks start as the parts of the ``entries`` vectors of smallest id (repeated rows count one by one, rows without id
    come last), of all where there are fewer. Rows that are null or hold null or non-finite components are dropped. A vector
    whose length is not that of the vector of smallest id, or no multiple of ``parts``, and one with a scaled component of
    2**26 or more cannot be coded: it is returned with null code and error and takes no part. Rows with equal labels share
    label_error, nulls among themselves. An empty table gives none. Other columns are not read, whatever their names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    given = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("e"))
    kept = given.where("e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    whole = kept.select("vec_id", "label", F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    whole = whole.withColumn("small", F.expr(f"forall(v, x -> x > {-LARGEST} and x < {LARGEST})"))
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    least = whole.where("small and size(v) > 0").orderBy(*order).limit(1).collect()
    size = len(least[0]["v"]) if least else 0
    fits = F.col("small") & (F.size("v") == size)
    if not size or size % parts:
        return whole.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"), F.lit(None).cast("bigint").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    rows = whole.where(fits).select("vec_id", "label", "v")
    first = np.array([r["v"] for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    n, width = len(first), size // parts
    book = Book(np.ascontiguousarray(first.reshape(n, parts, width).transpose(1, 0, 2)))
    b, state = max(1, n // 8), None
    for number in range(rounds):
        before, state = state, cut_lineage(_assign(rows if state is None else state, book, b, state is not None, "label", False))
        discard(before)
        count, total, deep = _sums(state, parts, n, width)
        used = count > 0
        book = Book(np.where(used[:, :, None], total // np.maximum(count, 1)[:, :, None], book.entries), book.entries)
        # the first round looked at all entries and says nothing about b
        if number:
            beyond = deep.sum() - np.cumsum(deep)
            b = int(np.clip(np.argmax(beyond <= BEYOND * deep.sum()), max(1, n // 16), max(1, n // 2)))
    coded = cut_lineage(_assign(rows if state is None else state, book, b, state is not None, "label", True))
    discard(state)
    digest = hashlib.sha256(",".join(str(x) for x in book.entries.ravel()).encode()).hexdigest()
    uncoded = whole.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    every = coded.union(uncoded)
    per = coded.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    joined = every.join(per, every["label"].eqNullSafe(per["_of"]), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql_round(number: int) -> str:
    """SQL of one round: distances to the entries of the round, nearest entry of each part, moved entries."""
    c = f"c{number}"
    return f"""
    d{number} AS MATERIALIZED (
        SELECT x.vec_id, x.p, e, CAST(sum((x.val - {c}.val) * (x.val - {c}.val)) AS BIGINT) AS dist
        FROM x JOIN {c} ON x.p = {c}.p AND x.i = {c}.i GROUP BY x.vec_id, x.p, e),
    a{number} AS MATERIALIZED (
        SELECT vec_id, p, e, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY dist, e) AS turn FROM d{number}) WHERE turn = 1),
    m{number} AS (SELECT x.p, a.e, x.i, CAST(floor(sum(x.val) / count(*)) AS BIGINT) AS val FROM x JOIN a{number} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY x.p, a.e, x.i),
    c{number + 1} AS MATERIALIZED (SELECT {c}.p, {c}.e, {c}.i, coalesce(m.val, {c}.val) AS val FROM {c} LEFT JOIN m{number} m USING (p, e, i))"""


@query(
    "op12_vector_codes",
    f"""
    WITH kept AS MATERIALIZED (
        SELECT vec_id, label, [CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT) FOR y IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([1 FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
    flat AS (SELECT vec_id, unnest(v) AS val, unnest(range(len(v))) AS pos, len(v) // 16 AS width FROM kept),
    x AS MATERIALIZED (SELECT vec_id, pos // width AS p, pos % width AS i, val FROM flat),
    start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept),
    c0 AS MATERIALIZED (SELECT p, e, i, val FROM x JOIN start USING (vec_id) WHERE e < 64),
    {_sql_round(0)},
    {_sql_round(1)},
    {_sql_round(2)},
    codes AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
    whole AS (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c2)
    SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM codes JOIN kept USING (vec_id), whole
    """,
)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
