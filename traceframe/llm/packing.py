"""Packing: sum-of-squares online packing of token ids into windows of a fixed size.

Each task packs the documents of its partition in their order. Whole windows of a long document are closed at once; what is
left of it goes, as one piece, to the fill level for which the sum of squared counts of partly filled windows becomes least
(Csirik et al. 2006), kept in an array of counts by level. What is open at a partition's end is joined and cut into full
windows, and the very last one into powers of two, which need no padding. Texts are not shuffled, memory is bounded by
``OPEN`` windows, and a partition that runs again yields the same windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import give_back, query, table
from traceframe.llm.spans import passes
from traceframe.llm.tokens import PieceEncoder

WINDOW = 2048
#: Open windows in a task beyond which they are joined and cut.
OPEN = 4096
#: Id that ends each document.
END = 1
TOKENIZER = "byte_bpe_50k.json"
_encoders: dict[str, PieceEncoder] = {}

Piece = tuple[int, int, np.ndarray]  # number of the document, ids of it before this piece, ids


class Windows:
    """Windows being filled. Closed ones are given to ``close`` as lists of pieces."""

    def __init__(self, close, window: int = WINDOW):
        self.close, self.window = close, window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level (0: a new window) that a piece of this size should join."""
        n, top = self.counts, self.window - size
        change = 2 * n[size : self.window + 1] + 1  # windows of the level that results
        change[-1] = 0  # full windows do not count
        change[1:] -= np.where(n[1 : top + 1] > 0, 2 * n[1 : top + 1] - 1, -(1 << 40))
        # of equally good levels the fullest
        return top - int(np.argmin(change[::-1]))

    def add(self, doc: int, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self.close([(doc, at, ids[at : at + self.window])])
        if whole < len(ids):
            # a copy, so that an open window does not hold all ids of a long document
            piece = (doc, whole, ids[whole:].copy() if whole else ids)
            level = self.level_for(len(piece[2]))
            if level:
                self.counts[level] -= 1
                held = self.open[level].pop()
            else:
                held = []
            held.append(piece)
            level += len(piece[2])
            if level == self.window:
                self.close(held)
            else:
                self.counts[level] += 1
                self.open[level].append(held)
                if self.counts.sum() > OPEN:
                    self.flush(last=False)

    def flush(self, last: bool = True) -> None:
        """Joins the open windows, fullest first, and cuts them at full windows. The rest stays open, or is cut into powers of two."""
        pieces = [p for level in self.open[::-1] for held in level for p in held]
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        left = sum(len(p[2]) for p in pieces)
        room, held = min(self.window, left), []
        if last and left < self.window:
            room = 1 << (left.bit_length() - 1) if left else 0
        for doc, start, ids in pieces:
            while len(ids):
                now = ids[:room]
                held.append((doc, start, now))
                start, ids, room, left = start + len(now), ids[len(now) :], room - len(now), left - len(now)
                if not room:
                    filled = sum(len(p[2]) for p in held)
                    if filled == self.window or last:
                        self.close(held)
                    else:
                        self.counts[filled] += 1
                        self.open[filled].append(held)
                    held = []
                    room = self.window if left >= self.window else (1 << (left.bit_length() - 1) if left else 0) if last else left


def encoder(name: str = TOKENIZER) -> PieceEncoder:
    """The encoder of a public tokenizer file, kept by the Python worker."""
    if name not in _encoders:
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        # a character of a byte-level piece stands for one byte
        sizes = np.array([len(piece) for piece, _ in sorted(tokenizer.get_vocab().items(), key=lambda x: x[1])])
        _encoders[name] = PieceEncoder(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], sizes)
    return _encoders[name]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id, offset; ``ids`` on demand.

    A null or empty text is the end id alone. Rows with equal ids are packed as documents of their own, and a null id stays
    null. Other columns are not read. sequence_id is the partition's number times 2**32 plus the number of the window in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32
        ids_of: list = []
        sizes: list[int] = []
        rows: list[tuple] = []
        closed = [0]

        def close(pieces: list[Piece]) -> None:
            offset = 0
            for doc, start, ids in pieces:
                rows.append((ids_of[doc], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), sizes[doc], base + closed[0], offset, *([ids] if with_ids else [])))
                offset += len(ids)
            closed[0] += 1

        windows = Windows(close, window)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(names)
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[7:]]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            ids_of += batch.column("doc_id").to_pylist()
            for _, _, texts in passes(batch.column("text")):
                for ids in encode(texts):
                    sizes.append(len(ids) + 1)
                    windows.add(len(sizes) - 1, np.append(ids, np.int32(END)))
                if len(rows) >= 10_000:
                    yield out()
        windows.flush()
        yield out()
        batch = texts = ids = None
        give_back()

    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return given.mapInArrow(run, schema + ", ids array<int>" * with_ids)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
