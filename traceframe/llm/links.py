"""Connected components of links that may be far more than one task holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that links reach.

    Large-star and small-star steps (Kiveris et al. 2014): every node hangs its larger neighbours, then itself and its
    smaller ones, on the smallest node it knows. Each round is written to the shared folder; it ends when every link
    points at a node that has no smaller neighbour. A node with very many links is a key of joins that Spark may split.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = _both_ways(now)
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        small = hung.join(least, "a")
        after = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = cut_lineage(after)
        # done when the links are stars: no node both hangs on one and holds others, and none hangs twice
        ends = now.groupBy("a").agg(F.count("*").alias("n"))
        chained = now.join(ends.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not chained and not ends.where("n > 1").limit(1).count():
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return cut_lineage(stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


def local_labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that links within one pair of blocks reach, for both sides. linked: which left and right vectors link."""
    a, b = np.nonzero(linked)
    la, lb = left.copy(), right.copy()
    while True:
        na, nb = la.copy(), lb.copy()
        np.minimum.at(na, a, lb[b])
        np.minimum.at(nb, b, na[a])
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb
