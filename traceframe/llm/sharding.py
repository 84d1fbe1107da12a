"""Sharding: proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash within their source and ranked; the fractional rank (2 * rank + 1) / (2 * rows of the
source) spreads each source evenly over [0, 1). The order by fractional rank is cut into equal shards, so each holds every
source in its share. Ranks come from counts of hash ranges plus a row number within a range, so a source of any size is
ranked by many tasks; positions in the whole order come about in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.llm.common import query, table

#: Ranges of the hash within a source, and of the fractional rank. The first is also cut into groups of RANGES ** 0.5.
RANGES = 1 << 16


def shuffle_hash(seed: int, key: Column) -> Column:
    """60 bits of an MD5 of seed and key; a null key hashes as an empty one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("bigint")


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot: one row for each given row.

    size: UTF-8 bytes of the text plus 1 (null: 1). text_crc32: of these bytes (null: as empty). Rows of a null source are
    a source of their own. Ties of the hash go by id, size and crc; rows equal in all of these are interchangeable.
    Shards differ by one row at most, and slots count from 0 in each. An empty table gives none. Other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    key = F.col(doc_id)
    rows = docs.select(
        key.alias("doc_id"), F.col(source).cast("string").alias("source"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"), shuffle_hash(seed, key).alias("_h"),
    ).withColumn("_range", F.shiftright("_h", 44))
    total = docs.count()
    ties = ("doc_id", "size", "text_crc32")

    counts = rows.groupBy("source", "_range").agg(F.count("*").alias("_n"))
    by_source = Window.partitionBy("source")
    before = counts.select(
        "source", "_range", (F.sum("_n").over(by_source.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(by_source).alias("_rows")
    )
    within = Window.partitionBy("source", "_range").orderBy("_h", *ties)
    numbered = rows.withColumn("_k", F.row_number().over(within) - 1).alias("r").join(before.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r._range") == F.col("b._range")))
    rank = F.col("_before") + F.col("_k")
    placed = numbered.select("r.*", ((2 * rank + 1).cast("double") / (2 * F.col("_rows")).cast("double")).alias("_f"))
    placed = placed.withColumn("_part", F.floor(F.col("_f") * RANGES).cast("int"))

    # the fractional ranks are known from the counts alone, but rounding decides their range: so they are counted
    step = 1 << 8
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    groups = sizes.groupBy(F.floor(F.col("_part") / step).alias("_group")).agg(F.sum("_n").alias("_m"))
    group_before = groups.select("_group", (F.sum("_m").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).alias("_base"))
    in_group = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    part_before = sizes.withColumn("_group", F.floor(F.col("_part") / step)).withColumn("_inner", F.sum("_n").over(in_group) - F.col("_n")).join(group_before, "_group")
    part_before = part_before.select("_part", (F.col("_base") + F.col("_inner")).alias("_offset"))
    order = Window.partitionBy("_part").orderBy("_f", F.col("source").asc_nulls_first(), "_h", *ties)
    at = placed.withColumn("_i", F.row_number().over(order) - 1).join(part_before, "_part").withColumn("_at", F.col("_offset") + F.col("_i"))
    at = at.withColumn("shard", F.expr(f"cast((_at * {shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return at.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("_at") - first).alias("slot"))


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interleave(table(spark, sf_dir, "documents"))
    return rows.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
