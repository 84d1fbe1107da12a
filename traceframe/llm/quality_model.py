"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Tokens are runs of lower-case letters, capitals, digits or other characters. Each of ``BUCKETS`` token hashes has a sparse
ternary index vector; its word vector is the sum of the index vectors of its neighbours in all texts. A document is the
mean and the spread of its tokens' normalised vectors. The network is trained on a bounded sample of labelled rows and
its probabilities are calibrated by a temperature on sampled rows that it never saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import arrow_map, bounded_sample, fold, labelled_sample, query, table, unit_hash
from traceframe.llm.spans import Texts, passes

BUCKETS = 1 << 12
SIZE = 32
#: Non-zero components of an index vector, and neighbours on each side.
ONES, REACH = 4, 2
#: Labelled rows of each label that the network is fitted on, at most (in expectation).
SAMPLE = 4000
_CLASS = np.full(256, 4, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_U = np.uint64


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and the text it is of."""
    inside = np.zeros(len(texts.data) + 2, np.int8)
    inside[1:-1] = _CLASS[texts.data]
    starts, ends, of = texts.runs(inside)
    return (texts.hashes(starts, ends) >> _U(52)).astype(np.int64), of


def _index_vectors(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    place = np.argsort(random.random((BUCKETS, SIZE)), 1)[:, :ONES]
    return place, np.where(np.arange(ONES) % 2, -1, 1)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """One vector of length 1 for each bucket, from all texts; zero where a token never has a neighbour.

    Each task sends one row a bucket at most, and so does the sum that the driver gets.
    """
    place, sign = _index_vectors()
    names = [f"v{i}" for i in range(SIZE)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * SIZE, np.int64)
        for batch in batches:
            for _, _, texts in passes(batch.column(0)):
                token, of = _tokens(texts)
                for gap in range(1, REACH + 1):
                    near = of[gap:] == of[:-gap]
                    left, right = token[:-gap][near], token[gap:][near]
                    # equal pairs are counted once; each count then adds its index vector
                    pair, n = np.unique(left * BUCKETS + right, return_counts=True)
                    left, right = pair // BUCKETS, pair % BUCKETS
                    for k in range(ONES):
                        np.add.at(total, left * SIZE + place[right, k], n * sign[k])
                        np.add.at(total, right * SIZE + place[left, k], n * sign[k])
        sums = total.reshape(BUCKETS, SIZE)
        used = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, i]) for i in range(SIZE))], names=["bucket", *names])

    schema = ", ".join(["bucket bigint", *(f"{n} bigint" for n in names)])
    rows = docs.select(F.col(text).cast("string")).mapInArrow(gather, schema).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).collect()
    out = np.zeros((BUCKETS, SIZE))
    for r in rows:
        out[r["bucket"]] = r[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _pool(texts: Texts, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the token vectors, and 1 for texts with tokens; zeros without."""
    token, of = _tokens(texts)
    out = np.zeros((texts.n, 2 * SIZE + 1))
    if len(token):
        begins = np.searchsorted(of, np.arange(texts.n))
        n = np.diff(np.append(begins, len(of)))
        full = np.flatnonzero(n)
        v = vectors[token]
        mean = np.add.reduceat(v, begins[full], axis=0, dtype=np.float64) / n[full, None]
        square = np.add.reduceat(v * v, begins[full], axis=0, dtype=np.float64) / n[full, None]
        out[full, :SIZE] = mean
        out[full, SIZE:-1] = np.sqrt(np.maximum(square - mean**2, 0))
        out[full, -1] = 1
    return out


def _forward(x: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(((x - net["centre"]) / net["scale"]) @ net["w1"] + net["b1"])
    return hidden, hidden @ net["w2"] + net["b2"]


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> dict:
    """Two layers, trained by Adam on the logistic loss."""
    random = np.random.default_rng(seed)
    net = {"centre": x.mean(0), "scale": x.std(0) + 1e-3, "w1": random.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": random.normal(0, hidden**-0.5, hidden), "b2": np.zeros(())}
    learned = ("w1", "b1", "w2", "b2")
    m, v, t = {k: 0 * net[k] for k in learned}, {k: 0 * net[k] for k in learned}, 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for at in range(0, len(x), 64):
            b = order[at : at + 64]
            h, s = _forward(x[b], net)
            d = (1 / (1 + np.exp(-np.clip(s, -35, 35))) - y[b]) / len(b)
            dh = d[:, None] * net["w2"] * (1 - h * h)
            grads = {"w1": ((x[b] - net["centre"]) / net["scale"]).T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": d.sum()}
            t += 1
            for k in learned:
                g = grads[k] + decay * net[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net[k] = net[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def _temperature(s: np.ndarray, y: np.ndarray) -> float:
    if not len(y):
        return 1.0
    return float(min(np.exp(np.linspace(-2, 3, 101)), key=lambda t: np.mean(np.logaddexp(0, s / t) - y * s / t)))


def fit(labelled: DataFrame, vectors: np.ndarray, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = SAMPLE, seed: int = 21, counts: dict[int, int] | None = None) -> dict | None:
    """The calibrated network, or None without rows of both labels. Only pooled vectors of the sample reach the driver.

    counts: rows of each label where ``labelled`` is a sample already, of ``labelled_sample``. Null texts count as empty ones,
    rows that repeat count each, other columns are not read.
    """
    sampled = counts is not None
    labelled = labelled.where(F.col(label).isin(0, 1))
    if not sampled:
        counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    chosen = labelled if sampled else bounded_sample(labelled, label, F.col(key), sample, seed)
    rows = pooled(chosen.select(text, F.col(label).alias("y"), (unit_hash(seed + 1, F.col(key)) < 0.2).alias("aside"), F.col(key).alias("k")), vectors, text).drop(text).collect()
    rows.sort(key=lambda r: (r["k"], r["pooled"]))
    x, y, aside = np.array([r["pooled"] for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["aside"] for r in rows])
    if len(set(y[~aside])) < 2:
        aside[:] = False
    net = train(x[~aside], y[~aside])
    net["temperature"] = _temperature(_forward(x[aside], net)[1], y[aside])
    kept = {k: min(n, sample) for k, n in counts.items()}
    net["offset"] = float(np.log(counts[1] / kept[1]) - np.log(counts[0] / kept[0]))
    return net


def pooled(docs: DataFrame, vectors: np.ndarray, text: str = "text") -> DataFrame:
    """Adds ``pooled``: the document vector of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors.astype(np.float32))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "pooled"]

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [np.zeros((0, 2 * SIZE + 1)), *(_pool(texts, sent.value) for _, _, texts in passes(batch.column(text)))]
        kept = [c for c in batch.schema.names if c != "pooled"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(list(np.concatenate(parts)), pa.list_(pa.float64()))], names=[*kept, "pooled"])

    return arrow_map(docs.withColumn(text, F.col(text).cast("string")), add, ", ".join([*kinds, "pooled array<double>"]))


def score(docs: DataFrame, vectors: np.ndarray, net: dict | None, text: str = "text", name: str = "quality") -> DataFrame:
    """Adds the probability of label 1 for each whole text. A null text scores as an empty one; without a network all score 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors.astype(np.float32), net))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name]

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, n = sent.value
        parts = [np.zeros(0)]
        for _, _, texts in passes(batch.column(text)):
            s = _forward(_pool(texts, words), n)[1] / n["temperature"] + n["offset"] if n else np.zeros(texts.n)
            parts.append(1 / (1 + np.exp(-np.clip(s, -35, 35))))
        kept = [c for c in batch.schema.names if c != name]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate(parts), pa.float64())], names=[*kept, name])

    return arrow_map(docs.withColumn(text, F.col(text).cast("string")), judge, ", ".join([*kinds, f"`{name}` double"]))


@query("op7_quality_model")
def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = word_vectors(docs)
    rows, counts = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1, SAMPLE, 21)
    net = fit(rows, vectors, counts=counts)
    scored = score(docs.select("doc_id", "text"), vectors, net, name="score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
