"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of one to three lower-case characters (everything but letters counts as a blank) are hashed into ``BUCKETS``.
Document frequencies count every training document; the weights are learned on a bounded sample by following the
regularised leader with an elastic-net penalty, and a temperature is fitted on sampled rows that the weights never saw.
Scoring reads whole texts: a text's value is the mean over its grams of idf times weight, so no counts are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import arrow_map, bounded_sample, fold, give_back, query, table, unit_hash

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Rows of each language that the weights are fitted on, at most (in expectation).
SAMPLE = 1000
#: Characters in one numpy pass; a longer text is a pass of its own.
PASS_CHARS = 1 << 17
#: Rows whose texts are Python strings at a time.
PASS_ROWS = 256
_LETTER = re.compile(r"[^\W\d_]")
_ASCII = np.full(128, 32, np.uint32)
_ASCII[97:123] = np.arange(97, 123)
_U = np.uint64


def _grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order: bucket of each gram and the text it is of; and the number of grams of each text."""
    texts = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 128
    points = np.where(low, _ASCII[np.where(low, points, 0)], np.where(points < 192, 32, points)).astype(np.uint64)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    out, total = [], np.zeros(len(texts))
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        value = np.full(n, order, np.uint64)
        for k in range(order):
            value = (value + points[k : k + n]) * _U(0x9E3779B97F4A7C15)
            value ^= value >> _U(29)
        bucket = ((value * _U(0xBF58476D1CE4E5B9)) >> _U(49)).astype(np.int32)
        mine = of[:n]
        if order > 1:
            whole = of[order - 1 :] == mine
            bucket, mine = bucket[whole], mine[whole]
        out.append((bucket, mine))
        total += np.maximum(sizes - order + 1, 0)
    return out, total


def _strings(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, a few rows at a time: a batch as Python strings is far larger than its Arrow form."""
    for at in range(0, len(column), PASS_ROWS):
        yield from column.slice(at, PASS_ROWS).to_pylist()


def _parts(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about PASS_CHARS."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= PASS_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows, and the number of rows. What is collected is one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        mark = np.zeros(BUCKETS, bool)
        for batch in batches:
            for texts in _parts(_strings(batch.column(0))):
                grams, _ = _grams(texts)
                cuts = [np.searchsorted(of, np.arange(len(texts) + 1)) for _, of in grams]
                for i in range(len(texts)):
                    mark[:] = False
                    for (bucket, _), cut in zip(grams, cuts):
                        mark[bucket[cut[i] : cut[i + 1]]] = True
                    seen += mark
                rows += len(texts)
        used = np.flatnonzero(seen)
        batch = texts = grams = cuts = None
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], rows))], names=["bucket", "n"])

    rows = docs.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in rows:
        if r["bucket"] >= 0:
            out[r["bucket"]] = r["n"]
    return out, next((r["n"] for r in rows if r["bucket"] < 0), 0)


def _vectors(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for part in _parts(texts):
        grams, total = _grams(part)
        cuts = [np.searchsorted(of, np.arange(len(part) + 1)) for _, of in grams]
        for i in range(len(part)):
            got = np.concatenate([b[c[i] : c[i + 1]] for (b, _), c in zip(grams, cuts)])
            at, n = np.unique(got, return_counts=True)
            out.append((at, n * idf[at] / max(total[i], 1)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, epochs: int = 5, seed: int = 7) -> np.ndarray:
    """Follow the regularised leader with elastic net, one coordinate a bucket and class; BUCKETS + 1 rows, the last one is the intercept."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    random = np.random.default_rng(seed)

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 0.1)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the labels likeliest, by a search on a grid of its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))

    return float(min(np.exp(np.linspace(-4, 4, 161)), key=loss))


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE, seed: int = 5) -> dict:
    """labels, weights with idf folded in, intercept, temperature. Learns from the given rows only; null labels are left out."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"), F.col(key).alias("key"))
    names = sorted(r["label"] for r in rows.select("label").distinct().collect())
    frequency, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + frequency)) + 1
    if not names:
        return {"labels": [], "weights": np.zeros((BUCKETS, 0), np.float32), "intercept": np.zeros(0), "temperature": 1.0}
    chosen = bounded_sample(rows, "label", F.col("key"), sample, seed).select("text", "label", (unit_hash(seed + 1, F.col("key")) < 0.2).alias("aside"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, aside = [], [], []
        for batch in batches:
            texts += [t or "" for t in batch.column("text").to_pylist()]
            labels += [names.index(x) for x in batch.column("label").to_pylist()]
            aside += batch.column("aside").to_pylist()
        if not texts:
            return
        labels, aside = np.array(labels), np.array(aside)
        vectors = _vectors(texts, idf)
        if aside.all():
            aside[:] = False
        w = train([v for v, a in zip(vectors, aside) if not a], labels[~aside], len(names))
        scores = np.array([x @ w[at] + 0.1 * w[-1] for (at, x), a in zip(vectors, aside) if a]).reshape(-1, len(names))
        fitted = temperature(scores, labels[aside])
        batch = texts = vectors = scores = None
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([w.ravel()], pa.list_(pa.float64())), pa.array([fitted])], names=["weights", "temperature"])

    # one task sees the sample, which is bounded whatever the table's size
    got = chosen.repartition(1).sortWithinPartitions(F.xxhash64("text", "label")).mapInArrow(learn, "weights array<double>, temperature double").collect()
    w = np.array(got[0]["weights"]).reshape(BUCKETS + 1, len(names))
    return {"labels": names, "weights": (w[:-1] * idf[:, None]).astype(np.float32), "intercept": 0.1 * w[-1], "temperature": got[0]["temperature"]}


def one_label(label: str) -> dict:
    """The model of a single label: every text with a letter has it."""
    return {"labels": [label], "weights": np.zeros((BUCKETS, 1), np.float32), "intercept": np.zeros(1), "temperature": 1.0}


def predict(docs: DataFrame, model: dict, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted label and its probability. A text that is null, empty or without a letter is ``und`` with score 0;
    so is every text when nothing could be learned."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in (name, score)]

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        labels, values = [], []
        for texts in _parts(_strings(batch.column(text))):
            grams, total = _grams(texts)
            sums = np.zeros((len(texts), len(m["labels"])))
            for bucket, of in grams:
                begins = np.searchsorted(of, np.arange(len(texts)))
                full = np.flatnonzero(np.diff(np.append(begins, len(of))))
                if len(full):
                    sums[full] += np.add.reduceat(m["weights"][bucket], begins[full], axis=0, dtype=np.float64)
            s = (sums / np.maximum(total, 1)[:, None] + m["intercept"]) / m["temperature"]
            if s.shape[1]:
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
            for i, t in enumerate(texts):
                known = s.shape[1] > 0 and _LETTER.search(t) is not None
                labels.append(m["labels"][best[i]] if known else "und")
                values.append(float(p[i, best[i]]) if known else 0.0)
        kept = [c for c in batch.schema.names if c not in (name, score)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(labels, pa.string()), pa.array(values, pa.float64())], names=[*kept, name, score])

    return arrow_map(docs.withColumn(text, F.col(text).cast("string")), judge, ", ".join([*kinds, f"`{name}` string", f"`{score}` double"]))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
