"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.session import cut_lineage, discard, remove_folder, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def unit_hash(seed: int, *columns: Column) -> Column:
    """A value in [0, 1) that depends on the columns and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")) / F.lit(float(1 << 53))


def bounded_sample(rows: DataFrame, label: str, key: Column, most: int, seed: int) -> DataFrame:
    """About ``most`` rows of each label (all where there are fewer), chosen by a hash of the key.

    The share kept of a label is ``most / count``, so the sample is bounded whatever the table's size.
    """
    share = rows.groupBy(label).agg(F.count("*").alias("_n")).collect()
    take = F.lit(0.0)
    for r in share:
        take = F.when(F.col(label).eqNullSafe(F.lit(r[label])), F.lit(min(1.0, most / max(1, r["_n"])))).otherwise(take)
    return rows.where(unit_hash(seed, key) < take)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of about ``most`` documents a label outside the held-out fold, and how many there are of each.

    Ids are matched and sampled first, so only the texts of the sample move. Labels other than 0 and 1 do not count; of an
    id with several labels the largest does.
    """
    given = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    given = given.groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = docs.select("doc_id").where(fold(F.col("doc_id"), folds) != held_out).join(given, "doc_id")
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    take = F.lit(0.0)
    for value, n in counts.items():
        take = F.when(F.col("label") == value, min(1.0, most / n)).otherwise(take)
    # written, so that Spark knows how small it is
    chosen = cut_lineage(ids.where(unit_hash(seed, F.col("doc_id")) < take).distinct())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id"), counts


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns that the frame does not have: the given ones, lengthened where they are taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker stays for later tasks, also of other stages, beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; batches for which it gives None vanish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out
        batch = out = None
        give_back()

    return df.mapInArrow(run, schema)


__all__ = ["ORACLES", "QUERIES", "arrow_map", "bounded_sample", "cut_lineage", "discard", "fold", "give_back", "labelled_sample", "query", "remove_folder", "scratch_folder", "table", "unit_hash", "unused"]
