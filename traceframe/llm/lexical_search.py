"""Ranked lexical search by bag deduplication: documents that an item set cannot tell apart are scored once.

A document is restricted to the vocabulary of the items: its bag is the vector of (term, occurrences). Bags and the length
measure m decide every score, so documents of equal bag and m are one class. Classes are grouped by a 64-bit hash together
with the bag itself, which verifies what the hash proposes; each class is scored once against all items of a block, and the
classes that reach an item's top are expanded to their members by ascending doc_id.

Why ``top`` classes an item suffice: ordered by falling score, then by smallest member, each class in front of another one
has at least one member that ranks before all members of the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.llm.common import cut_lineage, query, table
from traceframe.llm.spans import Texts, passes

#: Terms of a block of items, which is what tasks are sent; the documents are read once for each block.
BLOCK_TERMS = 1 << 18
#: Classes that are scored by one product, and doubles that one product may hold.
CLASSES, CELLS = 4096, 1 << 24
#: Parts of an item's candidates that are cut to the top before they meet.
PARTS = 64
_TERM = np.zeros(256, np.int8)
_TERM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_U = np.uint64


def term_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of the lower-cased texts, and the text that it is of."""
    inside = np.zeros(len(texts.data) + 2, np.int8)
    inside[1:-1] = _TERM[texts.data]
    starts, ends, of = texts.runs(inside)
    return texts.hashes(starts, ends), of


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_TERMS) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(item ids, sorted term hashes, item number and term number of each pair): the items in blocks of about ``most`` terms.

    Rows that repeat an item id are one item with the terms of all of them; items without a term have no pair.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in passes(batch.column("text"), lower=True):
                found, of = term_hashes(texts)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(row, end - row).take(pa.array(of)), pa.array(found.view(np.int64))], names=["item_id", "term"])

    given = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    pairs = cut_lineage(given.mapInArrow(terms, "item_id bigint, term bigint").distinct())
    n = pairs.count()
    blocks = max(1, math.ceil(n / most))
    part = F.pmod(F.xxhash64(F.lit(23), "item_id"), F.lit(blocks))
    for at in range(blocks):
        got = pairs.where(part == at).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        ids = got.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode") if got.num_rows else None
        known, term = np.unique(got.column("term").to_numpy().view(np.uint64), return_inverse=True)
        yield ids.dictionary.to_pylist(), known, ids.indices.to_numpy(), term.astype(np.int64)


def bags(docs: DataFrame, known: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): number of all terms of a text, and its bag restricted to the known hashes, by term number."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sent.value
        size = len(hashes)
        for batch in batches:
            for row, end, texts in passes(batch.column("text"), lower=True):
                found, of = term_hashes(texts)
                at = np.minimum(np.searchsorted(hashes, found), size - 1)
                hit = hashes[at] == found
                pairs, tf = np.unique(of[hit] * size + at[hit], return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(texts.n + 1) * size).astype(np.int32))
                columns = [batch.column("doc_id").slice(row, end - row), pa.array(np.bincount(of, minlength=texts.n).astype(np.int64))]
                columns += [pa.ListArray.from_arrays(offsets, pa.array((pairs % size).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(restrict, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _score(classes: DataFrame, weights: np.ndarray, item: np.ndarray, term: np.ndarray, n_items: int, top: int) -> DataFrame:
    """(item, score, class_key, least): of each task, the best ``top`` classes of each item with a score above 0.

    Sums of products are whole numbers below 2**53, so the products of doubles are exact.
    """
    if len(weights) and float(weights.max()) * 1e6 * np.bincount(item, minlength=1).max() >= 2.0**53:
        raise ValueError("an item has too many terms for exact scores")
    sent = classes.sparkSession.sparkContext.broadcast((weights, item, term))

    def best(items: np.ndarray, scores: np.ndarray, least: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((least, -scores, items))
        items = items[order]
        rank = np.arange(len(items)) - np.searchsorted(items, items)
        kept = order[rank < top]
        return items[rank < top], scores[kept], least[kept], keys[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, of_item, of_term = sent.value
        holds = np.zeros((len(w), n_items)) if len(w) * n_items <= CELLS else None
        if holds is not None:
            holds[of_term, of_item] = 1.0
        by_item = np.argsort(of_item, kind="stable")
        cuts = np.searchsorted(of_item[by_item], np.arange(n_items + 1))
        found = tuple(np.zeros(0, np.int64) for _ in range(4))
        rows = max(1, min(CLASSES, CELLS // max(1, len(w), n_items)))
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                lists = part.column("terms")
                terms, tf = lists.flatten().to_numpy(zero_copy_only=False), part.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                m = part.column("m").to_numpy()[row]
                gain = np.zeros((len(part), len(w)))
                gain[row, terms] = w[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                if holds is not None:
                    scores = gain @ holds
                else:
                    scores = np.stack([gain[:, of_term[by_item[cuts[i] : cuts[i + 1]]]].sum(1) for i in range(n_items)], 1)
                # an item's classes below its top of this block need not be looked at again
                if len(part) > top:
                    floor = np.partition(scores, len(part) - top, axis=0)[len(part) - top]
                    scores[scores < floor[None, :]] = 0
                r, i = np.nonzero(scores > 0)
                some = (i.astype(np.int64), scores[r, i].astype(np.int64), part.column("least").to_numpy()[r], part.column("class_key").to_numpy()[r])
                found = best(*(np.concatenate(x) for x in zip(found, some)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["item", "score", "least", "class_key"])

    return classes.mapInArrow(run, "item bigint, score bigint, least bigint, class_key bigint")


def search(docs: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0, equal scores by ascending doc_id.

    Terms are runs of letters and digits (every character beyond ASCII counts), A-Z in lower case. With N documents that have
    a term, L terms in all, n terms of a document, df documents with a term: w = floor(1000 ln((2 N + 2) / (2 df + 1))),
    m = 50 + 50 n N div L, and a document scores the sum of w * (10**9 tf div (1000 tf + 20 m)) over the item's terms.
    A text that is null or without a term is never found and counts nowhere. Each row is a document: rows that repeat an id
    are ranked one behind the other, and a row without id ranks after those of equal score that have one. Rows that repeat
    an item id are one item (null is an id, too). Empty tables give no rows. Very long texts are read whole. Other columns
    are not read. Terms are told apart by 64-bit hashes; classes are verified by their whole bags.
    """
    spark, out = docs.sparkSession, None
    for ids, known, item, term in item_blocks(items, item_id, item_text, block_terms):
        bag = cut_lineage(bags(docs, known, doc_id, text))
        total = bag.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not total["n"]:
            continue
        df = np.zeros(len(known), np.int64)
        for r in bag.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toLocalIterator():
            df[r["term"]] = r["n"]
        weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(x) + 1))) for x in df], np.float64)
        m = (F.lit(50) + F.expr(f"(50 * n * {total['n']}L) div {total['l']}L")).alias("m")
        keyed = bag.where("size(terms) > 0").select("doc_id", m, "terms", "tfs").withColumn("class_key", F.xxhash64("m", "terms", "tfs"))
        # a row without an id stands behind all others
        least = F.coalesce(F.min("doc_id"), F.lit(2**63 - 1)).alias("least")
        classes = keyed.groupBy("class_key", "m", "terms", "tfs").agg(least)
        scored = _score(classes, weights, item, term, len(ids), top)
        for keys in (["item", F.pmod(F.xxhash64("least"), F.lit(PARTS))], ["item"]):
            best = Window.partitionBy(*keys).orderBy(F.desc("score"), "least", "class_key")
            scored = scored.withColumn("_turn", F.row_number().over(best)).where(F.col("_turn") <= top).drop("_turn")
        scored = cut_lineage(scored)
        # of each class that reached a top: its first members; the bag tells classes of one hash apart
        member = Window.partitionBy("class_key", "m", "terms", "tfs").orderBy(F.asc_nulls_last("doc_id"))
        members = keyed.join(scored.select("class_key").distinct(), "class_key", "left_semi").withColumn("_turn", F.row_number().over(member)).where(F.col("_turn") <= top)
        first = Window.partitionBy("class_key", "m", "terms", "tfs")
        members = members.withColumn("least", F.coalesce(F.min("doc_id").over(first), F.lit(2**63 - 1))).select("class_key", "least", "doc_id")
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item bigint, item_id bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = scored.join(members, ["class_key", "least"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        part = ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op13_lexical_search",
    f"""
    WITH words AS MATERIALIZED (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
    lengths AS (SELECT doc_id, len(ts) AS n FROM words WHERE len(ts) > 0),
    total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM lengths),
    items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
    occurrences AS (SELECT doc_id, unnest(ts) AS term FROM words),
    tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM occurrences WHERE term IN (SELECT term FROM items) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
    gains AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))) AS gain
              FROM tf JOIN weights USING (term) JOIN lengths USING (doc_id), total),
    scores AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM items JOIN gains USING (term) GROUP BY ALL),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
               FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
