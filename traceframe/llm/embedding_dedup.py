"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative for each group.

Vectors of length 1 with a cosine of at least t are at most r = sqrt(2 - 2 t) apart. Each vector is at home in the cell of
its nearest centre; it also visits every lower-numbered cell whose border (the plane between the two centres) is within r,
so each linked pair meets in the lower of its two home cells and no link is lost, whatever the centres are. Cells are cut
into blocks of bounded size, pairs of blocks are multiplied in double precision, and a task yields for each vector its
links and one edge to the smallest vector that links in the pair of blocks reach, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import cut_lineage, discard, query, table, unit_hash
from traceframe.llm.links import components, local_labels

#: Vectors the centres are fitted on, at most (in expectation).
SAMPLE = 20_000
#: Vectors in a cell, on average, and in a block of a cell.
CELL, BLOCK = 4096, 2048
#: Centres at most, of all lengths of vectors together; they are sent to all tasks.
CELLS = 4096
#: Vectors that one product with the centres holds.
ROWS = 1024
#: Added to r against rounding; cosines are always computed exactly.
MARGIN = 1e-6


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 9) -> np.ndarray:
    """k centres of length 1 for rows of length 1; a centre that loses all rows keeps its place."""
    random = np.random.default_rng(seed)
    centres = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[at : at + ROWS] @ centres.T, 1) for at in range(0, len(x), ROWS)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of length 1 from lists of equal size."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(vectors: DataFrame, centres: dict[int, np.ndarray], radius: float) -> DataFrame:
    """(size, cell, home, vec_id, vector, weight): a row for the home cell and one for each lower-numbered cell within reach.

    centres: by length of the vectors; all vectors of a length without centres share one cell.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                rows = np.flatnonzero(lengths == size)
                c = sent.value.get(int(size))
                for first in range(0, len(rows), ROWS):
                    part = batch.take(pa.array(rows[first : first + ROWS]))
                    home = np.zeros(len(part), np.int64)
                    reach = np.ones((len(part), 1), bool)
                    if c is not None:
                        near = _matrix(part.column("vector")) @ c.T
                        home = near.argmax(1)
                        # centres have length 1; a little more against rounding
                        distance = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0)) + MARGIN
                        reach = (near.max(1)[:, None] - near) <= radius * distance
                        reach &= np.arange(len(c))[None, :] < home[:, None]
                        reach[np.arange(len(part)), home] = True
                    at, cell = np.nonzero(reach)
                    taken = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(cell, pa.int32()), pa.array(cell == home[at]), taken.column("vec_id"), taken.column("vector"), taken.column("weight")], names=["size", "cell", "home", "vec_id", "vector", "weight"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.mapInArrow(assign, f"size int, cell int, home boolean, vec_id bigint, vector {kind}, weight bigint")


def _centres(vectors: DataFrame, cell: int) -> dict[int, np.ndarray]:
    """Centres of each length of vectors that needs more than one cell.

    A length gets centres in proportion to its vectors, ``CELLS`` for all; at most half as many lengths get two or more.
    """
    sizes = vectors.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    wanted = {}
    for r in sizes.where(F.col("n") > max(cell, 2 * n / CELLS)).orderBy(F.desc("n")).limit(CELLS // 2).collect():
        wanted[r["size"]] = (r["n"], min(math.ceil(r["n"] / cell), math.ceil(CELLS * r["n"] / n)))
    if not wanted:
        return {}
    share = min(1.0, SAMPLE / sum(m for m, _ in wanted.values()))
    taken = vectors.where(F.size("vector").isin(*wanted)).where(unit_hash(17, F.col("vec_id")) < share).select("vector").toArrow().column("vector").combine_chunks()
    lengths = taken.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for size, (_, k) in wanted.items():
        own = np.flatnonzero(lengths == size)
        if min(k, len(own)) > 1:
            out[size] = spherical_kmeans(_matrix(taken.take(pa.array(own))), min(k, len(own)))
    return out


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        side = group.column("home_side").to_numpy(zero_copy_only=False)
        group = group.combine_chunks()
        ids = group.column("vec_id").to_numpy()
        weight = group.column("weight").to_numpy()
        x = _matrix(group.column("vector").combine_chunks())
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        linked = np.zeros((len(left), len(right)), bool)
        for at in range(0, len(left), 512):
            linked[at : at + 512] = x[left[at : at + 512]] @ x[right].T >= threshold
        # a block against itself holds each pair twice and each vector against itself
        linked &= ids[left][:, None] != ids[right][None, :]
        same = (side == 2).any()
        la, lb = local_labels(linked, ids[left], ids[right])
        of, to = [ids[left]], [la]
        n = [linked @ weight[right]]
        if not same:
            of, to, n = [*of, ids[right]], [*to, lb], [*n, linked.T @ weight[left]]
        of, to, n = np.concatenate(of), np.concatenate(to), np.concatenate(n).astype(np.int64)
        some = n > 0
        return pa.table({"vec_id": of[some], "to": to[some], "n": n[some]})

    return run


def near_groups(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each given row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
    length do not link with each other. Rows that repeat an id count as one node with the links of all its vectors, and
    such equal or near vectors of one id are no links; a row without id has no component and is not kept. Equal vectors
    are compared once and counted by their number. An empty table gives none. Other columns are not read.
    """
    given = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vector"))
    good = given.where("vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)").distinct()
    # one vector for all that are equal
    equal = cut_lineage(good.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")))
    same = good.join(equal.select("vector", F.col("vec_id").alias("to")), "vector").select("vec_id", "to")
    placed = cut_lineage(_cells(equal, _centres(equal, cell), math.sqrt(2 - 2 * threshold) + MARGIN))
    blocks = placed.groupBy("size", "cell").agg(F.ceil(F.count_if("home") / block).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / block).cast("int").alias("guests"))
    at = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    rows = placed.join(blocks, ["size", "cell"]).withColumn("at", at)
    # home blocks meet each other once and every block of guests; side 0: left, 1: right, 2: both
    to = F.when(F.col("home"), F.concat(
        F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda j: F.struct(F.least("at", j).alias("a"), F.greatest("at", j).alias("b"), F.lit(True).alias("inner"), F.when(j == F.col("at"), 2).when(j > F.col("at"), 0).otherwise(1).alias("home_side"))),
        F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("guests") - 1, F.lit(0))), lambda j: F.struct(F.col("at").alias("a"), j.alias("b"), F.lit(False).alias("inner"), F.lit(0).alias("home_side")))).otherwise(F.expr("array()")),
    )).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.col("homes") - 1, F.lit(0))), lambda j: F.struct(j.alias("a"), F.col("at").alias("b"), F.lit(False).alias("inner"), F.lit(1).alias("home_side"))))
    pairs = rows.select("size", "cell", "vec_id", "vector", "weight", F.explode(to).alias("p")).select("size", "cell", "p.*", "vec_id", "vector", "weight")
    links = cut_lineage(pairs.groupBy("size", "cell", "a", "b", "inner").applyInArrow(_compare(threshold), "vec_id bigint, to bigint, n bigint"))
    discard(placed)
    own_id = given.select("vec_id")
    edges = links.select(F.col("vec_id").alias("a"), F.col("to").alias("b")).union(same.select(F.col("vec_id").alias("a"), F.col("to").alias("b")))
    group = components(edges.where("a <> b"))
    weights = equal.select(F.col("vec_id").alias("to"), "weight")
    per = links.groupBy(F.col("vec_id").alias("to")).agg(F.sum("n").alias("n"))
    counts = same.join(weights, "to").join(per, "to", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = own_id.join(counts, "vec_id", "left").join(group, own_id["vec_id"] == group["node"], "left")
    component = F.coalesce("component", own_id["vec_id"])
    return out.select(own_id["vec_id"], F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(own_id["vec_id"] == component, F.lit(False)).alias("kept"))


@query(
    "op2_embedding_dedup",
    """
    WITH RECURSIVE whole AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE list_aggregate(embedding, 'count') = len(embedding) AND len(embedding) > 0),
    good AS MATERIALIZED (SELECT vec_id, v FROM whole WHERE isfinite(list_inner_product(v, v)) AND list_inner_product(v, v) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
              WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.9 END),
    reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT node, b FROM reach JOIN links ON seen = a),
    lowest AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
    counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN lowest ON vec_id = lowest.node LEFT JOIN counts ON vec_id = counts.node
    """,
)
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))
