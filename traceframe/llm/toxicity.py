"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 64-bit hashes of words, their stems (first bytes, so that inflected and compounded forms share a feature),
pairs of neighbouring words and pairs with one word between; a text has each of its features once. The weights are learned from a bounded sample of labelled rows with per-coordinate rates; the L1 term
leaves few of them, so what is sent to the executors is small (``WEIGHTS`` at most). Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import arrow_map, bounded_sample, fold, give_back, labelled_sample, query, table
from traceframe.llm.spans import Texts, mix, passes, starts_of

#: Labelled rows of each label that the model is fitted on, at most (in expectation).
SAMPLE = 4000
#: Features that occur in fewer rows of the sample are not learned.
LEAST_ROWS = 4
WEIGHTS = 1 << 16
#: Score of every text where nothing could be learned.
UNLEARNED = 0.25
_U = np.uint64
_WORD = np.zeros(256, np.int8)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_MARK = 1 << 20
#: Lengths of stems in bytes.
STEMS = (4, 5, 6)


def gram_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All features of the texts, with repetition, and the text that each is of. Words are runs of letters and digits."""
    inside = np.zeros(len(texts.data) + 2, np.int8)
    inside[1:-1] = _WORD[texts.data]
    starts, ends, of = texts.runs(inside)
    words = texts.hashes(starts, ends)
    parts, owners = [words], [of]
    for n in STEMS:
        longer = ends - starts > n
        parts.append(mix(texts.hashes(starts[longer], starts[longer] + n) + _U(n)))
        owners.append(of[longer])
    for gap, factor in ((1, 0xD1342543DE82EF95), (2, 0xAF251AF3B0F025B5)):
        if len(words) > gap:
            same = of[gap:] == of[:-gap]
            parts.append(mix(words[:-gap] * _U(factor) + words[gap:])[same])
            owners.append(of[gap:][same])
    return np.concatenate(parts), np.concatenate(owners)


def train(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 2.0, l2: float = 1.0, epochs: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """FTRL-proximal (McMahan et al. 2013) over rows of feature numbers; weights and intercept."""
    size = 1 + max((int(r.max()) for r in rows if len(r)), default=-1)
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    random = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * np.where(at == size, 0.0, l1)) / ((beta + np.sqrt(n[at])) / alpha + np.where(at == size, 0.0, l2))
        return np.where((np.abs(z[at]) <= l1) & (at != size), 0.0, w)

    rows = [np.append(r, size) for r in rows]
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = SAMPLE, seed: int = 11, counts: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes (sorted), their weights, and the intercept. Without rows of both labels every score is 0.5.

    counts: rows of each label where ``labelled`` is a sample already, of ``labelled_sample``. Null texts count as empty ones;
    rows that repeat count each; an empty table teaches nothing; other columns are not read.
    """
    sampled = counts is not None
    labelled = labelled.where(F.col(label).isin(0, 1))
    if not sampled:
        counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return np.zeros(0, np.uint64), np.zeros(0), 0.0
    chosen = (labelled if sampled else bounded_sample(labelled, label, F.col(key), sample, seed)).select(F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            for _, _, texts in passes(batch.column("text"), lower=True):
                grams, of = gram_hashes(texts)
                order = np.argsort(of, kind="stable")
                cuts = starts_of(of[order], texts.n)
                grams = grams[order]
                rows += [np.unique(grams[cuts[i] : cuts[i + 1]]) for i in range(texts.n)]
            labels += batch.column("label").to_pylist()
        known, seen = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.zeros(0, np.uint64), np.zeros(0, int))
        known = known[seen >= LEAST_ROWS]
        numbered = []
        for r in rows:
            at = np.searchsorted(known, r)
            at[at == len(known)] = 0
            numbered.append(at[known[at] == r] if len(known) else at[:0])
        w, intercept = train(numbered, np.array(labels))
        used = np.flatnonzero(w)
        used = used[np.argsort(-np.abs(w[used]), kind="stable")[:WEIGHTS]]
        batch = texts = grams = rows = numbered = None
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(known[used].view(np.int64), 0)), pa.array(np.append(w[used], intercept)), pa.array([False] * len(used) + [True])], names=["feature", "weight", "is_intercept"])

    # one task sees the sample, which is bounded whatever the table's size
    model = chosen.repartition(1).sortWithinPartitions(F.xxhash64("text")).mapInArrow(learn, "feature bigint, weight double, is_intercept boolean").collect()
    rows = sorted((r for r in model if not r["is_intercept"]), key=lambda r: r["feature"] % (1 << 64))
    intercept = next((r["weight"] for r in model if r["is_intercept"]), 0.0)
    # the sample has other shares of the labels than the table
    kept = {k: min(n, sample) for k, n in counts.items()}
    intercept += float(np.log(counts[1] / kept[1]) - np.log(counts[0] / kept[0]))
    return np.array([r["feature"] for r in rows], np.int64).view(np.uint64), np.array([r["weight"] for r in rows]), intercept


def learned(model: tuple[np.ndarray, np.ndarray, float]) -> bool:
    """Whether the scores depend on the texts; where they do not, nothing is to be rejected by them."""
    return len(model[0]) > 0


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", name: str = "toxicity") -> DataFrame:
    """Adds the score (0 to 1) of each whole text; a null text scores as an empty one. Other columns stay as they are."""
    features, weights, intercept = model
    if not len(features):
        features, weights = np.zeros(1, np.uint64), np.zeros(1)
    sent = docs.sparkSession.sparkContext.broadcast((features, weights, intercept))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name), f"`{name}` double"])

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, w, base = sent.value
        mark = np.zeros(_MARK, bool)
        mark[(known & _U(_MARK - 1)).astype(np.int64)] = True
        sums = [np.zeros(0)]
        for _, _, texts in passes(batch.column(text), lower=True):
            grams, of = gram_hashes(texts)
            maybe = mark[(grams & _U(_MARK - 1)).astype(np.int64)]
            grams, of = grams[maybe], of[maybe]
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            hit = known[at] == grams
            pairs = np.unique(of[hit] * len(known) + at[hit])
            sums.append(np.bincount(pairs // len(known), weights=w[pairs % len(known)], minlength=texts.n)[: texts.n])
        total = 1 / (1 + np.exp(-np.clip(np.concatenate(sums) + base, -35, 35)))
        kept = [c for c in batch.schema.names if c != name]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(total, pa.float64())], names=[*kept, name])

    return arrow_map(docs.withColumn(text, F.col(text).cast("string")), judge, schema)


def fit_labels(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = SAMPLE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """``fit`` on the labelled documents outside the held-out fold."""
    rows, counts = labelled_sample(docs, labels, label, folds, held_out, sample, seed)
    return fit(rows, sample=sample, counts=counts)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; where the labels teach nothing all have the same, ``UNLEARNED`` at most."""
    docs = table(spark, sf_dir, "documents")
    model = fit_labels(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model, name="score")
    if not learned(model):
        scored = scored.withColumn("score", F.least("score", F.lit(UNLEARNED)))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
