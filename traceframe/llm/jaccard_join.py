"""N-gram Jaccard join: all links between documents whose sets of 5-word shingles overlap by 75 percent or more.

Sets r and s (r the larger) link only if they differ in at most H = (|r| + |s|) // 7 shingles. Sizes fall into bands; the
shingles of a set are hashed into the m segments of a band. If r allows each segment j a difference of v(j), -1 (skip),
0 (equal) or 1 (one shingle more or less), and the sum of v(j) + 1 exceeds H, then a linked s keeps to v in some segment
that is not skipped (pigeonhole). So every set is indexed by its segment subsets in its own band, and in the first
``DELETABLE`` segments also by the subsets with one shingle left out; and it probes its own band and the next lower one
with the segments that cost least. Costs are the numbers of other sets with the same subset, counted over all documents.
A set with enough segments that nobody shares probes nothing, which is the common case; passages that many documents
hold are skipped as long as the rest suffices.

Candidates are compared exactly by their shingles. The documents of a signature are gathered under the one of them that
shares most, so a family of near copies comes together once instead of once for each signature. Those that ask are compared
with those that are indexed in blocks of bounded size, by products of incidence matrices; a block yields for each document one
edge to the smallest document that its links reach, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.llm.common import cut_lineage, query, table
from traceframe.llm.links import components, local_labels
from traceframe.llm.spans import Texts, mix, passes, starts_of, windows

WIDTH = 5
#: Segments of a band in which subsets with one shingle left out are indexed.
DELETABLE = 2
#: Segments of a band, times what a full set needs.
SLACK = 1.25
#: Documents of a block, and columns of an incidence matrix.
BLOCK, COLUMNS = 256, 1 << 15
#: Parts that the rows of a family are dealt to when its size is counted.
PARTS = 1024
_U = np.uint64
# roles of signature rows; odd ones of view 1 (the next lower band) follow those of view 0
OWN, LEFT_OUT, DOWN, UPGRADE = 0, 1, 2, 3


def _bands(most: int = 1 << 40) -> np.ndarray:
    """Largest size of each band; bands are at least 4/3 wide, so partners lie in the own band or the next lower one."""
    tops = [3]
    while tops[-1] < most:
        tops.append(tops[-1] * 16 // 9)
    return np.array(tops, np.int64)


TOPS = _bands()
SEGMENTS = np.ceil(SLACK * (TOPS // 3 + 1)).astype(np.int64)


def shingle_sets(texts: Texts) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    starts, ends, of = texts.words()
    words = texts.hashes(starts, ends)
    cuts = starts_of(of, texts.n)
    full, first = windows(words, of, WIDTH)
    at = np.searchsorted(first, cuts)
    out = []
    for i in range(texts.n):
        n = cuts[i + 1] - cuts[i]
        if n >= WIDTH:
            # faster than np.unique, which hashes
            own = np.sort(full[at[i] : at[i + 1]])
            out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own)
        elif n:
            out.append(windows(words[cuts[i] : cuts[i + 1]], np.zeros(n, np.int64), int(n))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signatures:
    """Segment subsets of many sets in one view (0: own band, 1: next lower one)."""

    def __init__(self, sets: list[np.ndarray], view: int, salt: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        band = np.searchsorted(TOPS, sizes) - view
        # sets of up to three shingles link with equal sets only, and are indexed for those of four
        low = -(-3 * sizes // 4)
        self.active = (sizes > 0) & (band >= 0) & ((view == 0) | (low <= TOPS[np.maximum(band, 0)]))
        self.band = np.where(self.active, band, 0)
        self.allowed = np.where(self.active, (2 * sizes if view == 0 else sizes + TOPS[self.band]) // 7, 0)
        m = np.where(self.active, SEGMENTS[self.band], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        doc = np.repeat(np.arange(len(sets)), np.where(self.active, sizes, 0))
        tokens = np.concatenate([s for s, on in zip(sets, self.active) if on] or [np.zeros(0, np.uint64)])
        spread = mix(tokens + _U((salt + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        segment = ((spread >> _U(32)) * m[doc].astype(np.uint64) >> _U(32)).astype(np.int64)
        value = mix(spread ^ _U(0xE7037ED1A0B428DB))
        at = base[doc] + segment
        self.sums = np.zeros(base[-1], np.uint64)
        np.add.at(self.sums, at, value)
        self.size = np.bincount(at, minlength=base[-1])
        self.doc = np.repeat(np.arange(len(sets)), m)
        self.segment = np.arange(base[-1]) - base[self.doc]
        self.full = np.flatnonzero(self.size)
        # upgraded segments: one row for each shingle left out; the last one of a segment may not go, an empty subset is nobody's key
        self.up = np.flatnonzero((self.segment < DELETABLE) & (self.size > 1))
        cut = np.flatnonzero((segment < DELETABLE) & (self.size[at] > 1)) if len(at) else np.zeros(0, np.int64)
        self.cut_at, self.cut_sums = at[cut], self.sums[at[cut]] - value[cut]

    def keys(self, at: np.ndarray, sums: np.ndarray, space: int) -> np.ndarray:
        place = (self.band[self.doc[at]] * 4 + space).astype(np.uint64) * _U(0x8EBC6AF09C88C6E3) + self.segment[at].astype(np.uint64) * _U(0x589965CC75374CC3)
        return (mix(sums + mix(place)) >> _U(17)).astype(np.int64)  # 47 bits; a clash is only one more candidate

    def slots(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each set: segments that are not empty, and upgrades."""
        return np.bincount(self.doc[self.full], minlength=n), np.bincount(self.doc[self.up], minlength=n)

    def rows(self, view: int, probing: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(key, number of the set, role)."""
        out = []
        whole = self.keys(self.full, self.sums[self.full], 0)
        if view == 0:
            out.append((whole, self.doc[self.full], OWN))
            out.append((self.keys(self.cut_at, self.cut_sums, 1), self.doc[self.cut_at], LEFT_OUT))
        else:
            ask = probing[self.doc[self.full]]
            out.append((whole[ask], self.doc[self.full][ask], DOWN))
        for a in range(DELETABLE):
            up = self.up[(self.segment[self.up] == a) & probing[self.doc[self.up]]]
            cut = (self.segment[self.cut_at] == a) & probing[self.doc[self.cut_at]]
            role = UPGRADE + 2 * view + a
            for at, sums, space in ((up, self.sums[up], 0), (up, self.sums[up], 1), (self.cut_at[cut], self.cut_sums[cut], 0)):
                out.append((self.keys(at, sums, space), self.doc[at], role))
        return out


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for row, end, texts in passes(batch.column("text"), lower=True):
        yield batch.slice(row, end - row), shingle_sets(texts)


def set_facts(docs: DataFrame, salt: int = 0) -> DataFrame:
    """One row a document: size and two hashes of its set, and for each view what it may differ in and its slots."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets_of(batch):
                size = np.array([len(s) for s in sets], np.int64)
                full, tokens = np.flatnonzero(size), np.concatenate(sets)
                begins = (np.cumsum(size) - size)[full]
                columns = [part.column("doc_id"), pa.array(size)]
                for fold, values in ((np.bitwise_xor, mix(tokens)), (np.add, tokens)):
                    digest = np.zeros(len(sets), np.uint64)
                    if len(full):
                        digest[full] = fold.reduceat(values, begins) >> _U(1)
                    columns.append(pa.array(digest.astype(np.int64)))
                for view in (0, 1):
                    signed = Signatures(sets, view, salt)
                    full, up = signed.slots(len(sets))
                    need = np.where(signed.active & (signed.allowed > 0), signed.allowed + 1, 0)
                    columns += [pa.array(need, pa.int64()), pa.array(full + up, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h1", "h2", "need0", "slots0", "need1", "slots1"])

    return docs.mapInArrow(facts, "doc_id bigint, n bigint, h1 bigint, h2 bigint, need0 bigint, slots0 bigint, need1 bigint, slots1 bigint")


def signature_rows(docs: DataFrame, salt: int = 0) -> DataFrame:
    """(key, doc_id): the key holds the signature and, in its three low bits, the role."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets_of(batch):
                ids = part.column("doc_id").to_numpy()
                probing = np.array([len(s) > 3 for s in sets], bool)
                keys, of = [], []
                for view in (0, 1):
                    for key, doc, role in Signatures(sets, view, salt).rows(view, probing):
                        keys.append(key << 3 | role)
                        of.append(doc)
                keys, of = np.concatenate(keys), np.concatenate(of)
                for at in range(0, len(keys), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 200_000]), pa.array(ids[of[at : at + 200_000]])], names=["key", "doc_id"])

    return docs.mapInArrow(emit, "key bigint, doc_id bigint")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of signatures that several documents have, one of them in the index."""
    group = Window.partitionBy("sig")
    index = F.col("role") <= LEFT_OUT
    return (
        rows.withColumn("_low", F.min("doc_id").over(group)).withColumn("_high", F.max("doc_id").over(group))
        .withColumn("cost", F.sum(index.cast("int")).over(group)).where("_low < _high and cost > 0").drop("_low", "_high")
    )


def candidates(docs: DataFrame, facts: DataFrame, salt: int = 0) -> DataFrame:
    """(lead, doc_id, asks, held): who is to be compared under a leading document, each one that asks with each one held.

    facts: the ``set_facts`` of the documents that stand for their sets.
    """
    rows = signature_rows(docs, salt)
    sig = F.shiftrightunsigned("key", 3)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(partitions, sig).select(sig.alias("sig"), F.col("key").bitwiseAND(7).cast("int").alias("role"), "doc_id")
    several = cut_lineage(_shared(rows))
    several = cut_lineage(_shared(several.drop("cost").join(facts, "doc_id")))
    view = F.when(F.col("role").isin(OWN, UPGRADE, UPGRADE + 1), 0).otherwise(1)
    asked = several.where(f"role <> {LEFT_OUT}").withColumn("view", view)
    asked = asked.withColumn("need", F.when(F.col("view") == 0, F.col("need0")).otherwise(F.col("need1"))).where("need > 0")
    asked = asked.withColumn("slot", F.when(F.col("role") >= UPGRADE, -F.col("role").cast("bigint")).otherwise(F.col("sig")))
    slots = asked.groupBy("doc_id", "view", "slot").agg(F.sum("cost").alias("cost"), F.max("need").alias("need"), F.max(F.when(F.col("view") == 0, F.col("slots0")).otherwise(F.col("slots1"))).alias("slots"))
    own = Window.partitionBy("doc_id", "view")
    # slots without a partner come first and cost nothing
    chosen = (
        slots.withColumn("_free", F.col("slots") - F.count("*").over(own)).withColumn("_turn", F.row_number().over(own.orderBy("cost", "slot")))
        .where(F.col("_turn") <= F.col("need") - F.col("_free")).select("doc_id", "view", "slot")
    )
    probes = cut_lineage(asked.join(chosen, ["doc_id", "view", "slot"], "left_semi").select("sig", "doc_id").distinct())
    index = several.where(f"role <= {LEFT_OUT}").select("sig", "doc_id").distinct().join(probes.select("sig").distinct(), "sig", "left_semi")
    members = probes.select("sig", "doc_id", F.lit(True).alias("asks")).union(index.select("sig", "doc_id", F.lit(False).alias("asks")))
    # the member that shares most with others is the likeliest original of its family
    shares = several.groupBy("doc_id").agg(F.sum("cost").alias("shares"))
    leads = members.join(shares, "doc_id").groupBy("sig").agg(F.max(F.struct("shares", "doc_id")).alias("top")).select("sig", F.col("top.doc_id").alias("lead"))
    return cut_lineage(members.join(leads, "sig").groupBy("lead", "doc_id").agg(F.bool_or("asks").alias("asks"), F.bool_or(~F.col("asks")).alias("held")))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shingles that each left set has in common with each right one."""
    out = np.zeros((len(left), len(right)))
    if len(left) * len(right) <= 16:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                out[i, j] = len(np.intersect1d(a, b, assume_unique=True))
        return out
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for sets in (left, right):
        tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, tokens), max(len(common) - 1, 0))
        known = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
        sides.append((of[known], at[known]))
    for first in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - first)
        a, b = (np.zeros((len(s), width), np.float32) for s in (left, right))
        for matrix, (of, at) in ((a, sides[0]), (b, sides[1])):
            here = (at >= first) & (at < first + width)
            matrix[of[here], at[here] - first] = 1
        out += a @ b.T
    return out


def compare_blocks(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): for each document with a link, one edge to the smallest one that links within a pair of blocks reach."""
    # a family may hold a third of all documents: its size is added up from parts, and its rows meet it part by part
    groups = groups.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(PARTS)).cast("int"))
    parts = groups.groupBy("lead", "part").agg(F.count_if("asks").alias("asks"), F.count_if("held").alias("held"))
    family = Window.partitionBy("lead")
    sizes = parts.select("lead", "part", *(F.ceil(F.sum(c).over(family) / BLOCK).cast("int").alias(n) for c, n in (("asks", "rows"), ("held", "columns"))))
    groups = groups.join(sizes, ["lead", "part"]).where("rows > 0 and columns > 0")

    def side(flag: str, number: int, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col(own)).cast("int").alias(own)
        return groups.where(flag).select("lead", "doc_id", F.lit(number).alias("side"), block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    placed = side("asks", 0, "rows", "columns").unionByName(side("held", 1, "columns", "rows"))
    texts = docs.join(groups.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = placed.join(texts, "doc_id").repartition("lead", "rows", "columns").sortWithinPartitions("lead", "rows", "columns")

    def links(ids: list[int], sides: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left, right = ([i for i, s in enumerate(sides) if s == which] for which in (0, 1))
        if not left or not right:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.array(ids)
        size = np.array([len(s) for s in sets])
        common = _overlaps([sets[i] for i in left], [sets[i] for i in right])
        linked = (common > 0) & (100 * common >= 75 * (size[left][:, None] + size[right][None, :] - common)) & (at[left][:, None] != at[right][None, :])
        la, lb = local_labels(linked, at[left], at[right])
        of, to = np.concatenate([at[left], at[right]]), np.concatenate([la, lb])
        return of[of != to], to[of != to]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ids: list[int] = []
        sides: list[int] = []
        sets: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            of, to = links(ids, sides, sets)
            ids.clear(), sides.clear(), sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(to, pa.int64())], names=["a", "b"])

        for batch in batches:
            for part, some in _sets_of(batch):
                columns = [part.column(c).to_pylist() for c in ("lead", "rows", "columns", "doc_id", "side")]
                for lead, row, column, doc, which, own in zip(*columns, some):
                    if held != (lead, row, column):
                        if ids:
                            yield out()
                        held = (lead, row, column)
                    ids.append(doc)
                    sides.append(which)
                    sets.append(own)
        if ids:
            yield out()

    return rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each given row.

    Words: ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z; a text of fewer than five words is one shingle. A text that is null
    or has no words has an empty set and is its own component. Rows that repeat an id count as one document with all
    their sets; a row without id links with nothing and has no component. Other columns are not read.
    """
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    facts = cut_lineage(set_facts(given))
    named = facts.where("doc_id is not null and n > 0")
    stands = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("to"), F.min("n").alias("n"), *(F.min(c).alias(c) for c in ("need0", "slots0", "need1", "slots1")))
    equal = named.join(stands.select("h1", "h2", "to"), ["h1", "h2"]).where("doc_id <> to").select(F.col("doc_id").alias("a"), F.col("to").alias("b"))
    kept = cut_lineage(stands.select(F.col("to").alias("doc_id"), "n", "need0", "slots0", "need1", "slots1"))
    known = given.where("doc_id is not null")
    links, salt = compare_blocks(candidates(known, kept), known), 0
    short = kept.where("need0 > slots0 or need1 > slots1")
    while short.limit(1).count():
        # too many empty segments by chance: these sets ask again under another hash, of sets of near sizes only
        salt += 1
        bounds = cut_lineage(short.select(F.explode(F.sequence(F.floor(F.log2(F.col("n") * 0.74)), F.ceil(F.log2("n")))).alias("size")).distinct())
        near = cut_lineage(kept.join(bounds, F.floor(F.log2("n")) == F.col("size"), "left_semi"))
        again = known.join(near, "doc_id", "left_semi")
        fresh = set_facts(again, salt).groupBy("doc_id", "n").agg(*(F.max(c).alias(c) for c in ("need0", "slots0", "need1", "slots1")))
        asks = short.select("doc_id", F.lit(1).alias("_asks"))
        fresh = fresh.join(asks, "doc_id", "left").select("doc_id", "n", "slots0", "slots1", *(F.when(F.col("_asks") == 1, F.col(c)).otherwise(0).alias(c) for c in ("need0", "need1")))
        fresh = cut_lineage(fresh)
        links = links.union(compare_blocks(candidates(again, fresh, salt), again))
        short = fresh.where("need0 > slots0 or need1 > slots1")
    found = components(equal.union(links))
    joined = facts.join(found, facts["doc_id"] == found["node"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


@query(
    "op5_jaccard_join",
    r"""
    WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
    places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0),
    sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM places),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
    reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT node, b FROM reach JOIN links ON seen = a),
    lowest AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id
    FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN lowest ON d.doc_id = lowest.node
    """,
)
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


