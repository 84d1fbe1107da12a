"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed as a protobuf, and its tokenizer is rebuilt: the normaliser (character map, space rules), the
marker for spaces, the pieces with their scores (as unigram scores, or as merges for a pair-merging model) and bytes for
characters outside the vocabulary. ``encode_texts`` adds the ids of whole texts and checks that they decode to the text;
``verify`` compares ids and texts with the sentencepiece package.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import arrow_map, query, table
from traceframe.llm.spans import Texts, passes
from traceframe.llm.tokens import WIDE_SPACE, PieceEncoder

MARKER = "▁"
MODEL = "piece_bpe_32k.model"
# numbers of the public protobuf schema (fixed values)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_SPACES = re.compile(" {2,}")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    unknown_text: str = " \u2047 "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at += 1
            if data[at - 1] < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            out.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            out.kind, out.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            out.unknown_text = f[44].decode() if 44 in f else out.unknown_text
        elif number == 3:
            f = dict(_fields(value))
            out.charsmap, out.dummy_prefix, out.remove_extra, out.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    return out


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, the best-scored results first."""
    scores = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    number = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = [(-scores[p], number[p[:k]], number[p[k:]], p[:k], p[k:]) for p in scores for k in range(1, len(p)) if p[:k] in scores and p[k:] in scores]
    return [(a, b) for *_, a, b in sorted(found)]


def unigram_scores(model: Model) -> list[tuple[str, float]]:
    """Pieces and scores of the lattice. Pieces that no text may match (control, unknown, unused, bytes) get names with a space
    in them, which a text whose spaces are markers never has, and a score that leaves the least one as it is. User pieces get
    the score that lets them win."""
    normal = [s for _, s, kind in model.pieces if kind == NORMAL] or [0.0]
    least, most = min(normal), max(normal)
    out = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind == USER:
            out.append((piece, len(piece.encode()) * most - 0.1))
        else:
            out.append((piece, score) if kind == NORMAL else (f" {i}", least))
    return out


def build(model: Model):
    """The tokenizer. It replaces spaces by markers; what else the model does to a text before, ``Codec.normal`` does."""
    from tokenizers import Tokenizer, models, normalizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges_of(model), unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM and model.escape and unknown is not None:
        # characters outside the vocabulary become bytes afterwards, see ``Codec.whole``
        core = models.Unigram(unigram_scores(model), unknown, False)
    elif model.kind == UNIGRAM:
        raise ValueError("a unigram model needs an unknown piece and markers for spaces")
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor pair merging")
    tokenizer = Tokenizer(core)
    if model.escape:
        tokenizer.normalizer = normalizers.Replace(" ", MARKER)
    return tokenizer


def may_be_cut(model: Model) -> bool:
    """Whether texts can be encoded in pieces cut before white space: it merges pairs and no piece joins what stands before a space with it."""
    crossing = any(MARKER in p.lstrip(MARKER) or any(c.isspace() for c in p[1:]) for p, _, kind in model.pieces if kind in (NORMAL, USER))
    return not crossing and model.kind == BPE and model.byte_fallback and not model.charsmap and not model.remove_extra and model.escape


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, data: bytes):
        from tokenizers import normalizers

        self.data, self.model = data, parse_model(data)
        self.tokenizer = build(self.model)
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        kinds = [kind for _, _, kind in self.model.pieces]
        self.unknown = next((i for i, kind in enumerate(kinds) if kind == UNKNOWN), None)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        values = []
        for piece, _, kind in self.model.pieces:
            if kind == UNKNOWN:
                values.append(self.model.unknown_text.encode())
            else:
                values.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else piece.replace(MARKER, " ").encode())
        # ids outside the vocabulary stand for the unknown text
        values.append(self.model.unknown_text.encode())
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.values = np.frombuffer(b"".join(values), np.uint8)
        #: Pieces that begin with a marker; the first of a text loses it.
        self.marked = np.array([kind not in (UNKNOWN, CONTROL, BYTE) and p.startswith(MARKER) for p, _, kind in self.model.pieces] + [False])
        self.pieces = PieceEncoder(self._plain, self.sizes, WIDE_SPACE + MARKER) if may_be_cut(self.model) else None

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def normal(self, text: str) -> str:
        """The text as the lattice or the merges see it: characters mapped, runs of spaces one space and none at the ends (if the
        model says so), a marker in front of a text that is not empty."""
        m, given = self.model, text
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if m.remove_extra:
            text = _SPACES.sub(" ", text.lstrip(" "))
            given = text
        if m.dummy_prefix and given:
            text = " " + text
        space = " "
        if m.escape:
            text, space = text.replace(" ", MARKER), MARKER
        return text.rstrip(space) if m.remove_extra else text

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, encoded side by side by the library's threads."""
        texts = [self.normal(t) for t in texts]
        if self.model.kind == BPE or not self.model.byte_fallback:
            return [np.array(ids, np.int32) for ids in self._plain(texts)]
        out = []
        for text, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            missing = np.flatnonzero(ids == self.unknown)
            if len(missing):
                parts, done = [], 0
                for i in missing:
                    a, b = e.offsets[i]
                    parts += [ids[done:i], np.array([self.byte_ids.get(x, self.unknown) for x in text[a:b].encode()], np.int32)]
                    done = i + 1
                ids = np.concatenate([*parts, ids[done:]])
            out.append(ids)
        return out

    def encode(self, texts: Texts) -> list[np.ndarray]:
        if self.pieces:
            if self.model.dummy_prefix:
                # one more space in front of each text that is not empty
                full = np.diff(texts.bounds) > 0
                data = np.insert(texts.data, texts.bounds[:-1][full], 32)
                texts = Texts(data, texts.bounds + np.concatenate([[0], np.cumsum(full)]))
            return self.pieces(texts)
        blob = texts.data.tobytes()
        return self.whole([blob[a:b].decode() for a, b in zip(texts.bounds, texts.bounds[1:])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes that the ids stand for; an id outside the vocabulary stands for the unknown text."""
        ids = np.where((ids < 0) | (ids >= len(self.sizes)), len(self.sizes) - 1, ids)
        size = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.values[np.repeat(self.at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        lead = 0
        if self.model.dummy_prefix or self.model.remove_extra:
            # pieces lose their marker as long as nothing stands before them; without ``remove_extra`` one does
            for i in range(len(ids)):
                lead += bool(self.marked[ids[i]])
                if size[i] > self.marked[ids[i]] or (lead and not self.model.remove_extra):
                    break
        return out[lead:]


def as_text(data: bytes) -> str:
    """UTF-8 as text, one U+FFFD for each byte that belongs to no character."""
    return data.decode(errors="traceframe.each")


codecs.register_error("traceframe.each", lambda e: ("\ufffd" * (e.end - e.start), e.end))

_codecs: dict[str, Codec] = {}


def codec(name: str = MODEL) -> Codec:
    """The codec of a public model file, kept by the Python worker."""
    if name not in _codecs:
        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as file:
            _codecs[name] = Codec(file.read())
    return _codecs[name]


def encode_texts(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``round_trip`` (the ids decode to the text) for each whole text; a null text has null ids
    and counts as zero tokens, an empty one has no ids. Repeated rows are encoded each, an empty table stays empty, very long
    texts are encoded whole. Columns of these names are replaced, all others stay.

    A model that maps characters or takes runs of spaces as one does not keep them, so ``round_trip`` is false for such texts."""
    added = ("ids", "n_tokens", "round_trip")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            kept = [c for c in batch.schema.names if c not in added]
            column = batch.column(text)
            for row, end, texts in passes(column):
                ids = own.encode(texts)
                same = [own.decode(i) == texts.data[a:b].tobytes() for i, a, b in zip(ids, texts.bounds, texts.bounds[1:])]
                bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                given = column.slice(row, end - row).is_null().to_numpy(zero_copy_only=False)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(bounds, mask=np.append(given, False)), flat) if given.any() else pa.ListArray.from_arrays(bounds, flat)
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists, pa.array(np.diff(bounds), pa.int64()), pa.array(same)], names=[*kept, *added])

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, ", ".join([*kinds, "ids array<int>", "n_tokens bigint", "round_trip boolean"]))


def decode_ids(docs: DataFrame, ids: str = "ids", model: str = MODEL, name: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for (each byte that is not UTF-8 as U+FFFD); a null list gives null. A null or an id outside the
    vocabulary inside a list stands for the unknown text."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model)
        kept = [c for c in batch.schema.names if c != name]
        texts = [None if x is None else as_text(own.decode(np.array([-1 if i is None else i for i in x], np.int64))) for x in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, name])

    return arrow_map(docs, run, ", ".join([*kinds, f"`{name}` string"]))


def verify(encoded: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL, name: str = "parity") -> DataFrame:
    """Adds whether the sentencepiece package gives the same ids for the text and the same text for the ids; null texts have null.

    Two ways of cutting whose scores differ by less than a float's last digits may be told apart otherwise there, which shows here."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != name]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import sentencepiece

        own = codec(model)
        other = sentencepiece.SentencePieceProcessor(model_proto=own.data)
        kept = [c for c in batch.schema.names if c != name]
        same = []
        for given, got in zip(batch.column(text).to_pylist(), batch.column(ids).to_pylist()):
            if given is None or got is None:
                same.append(None)
            else:
                same.append(other.encode(given) == got and other.decode(got) == as_text(own.decode(np.array(got, np.int64))))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(same, pa.bool_())], names=[*kept, name])

    return arrow_map(encoded.withColumn(text, F.col(text).cast("string")), run, ", ".join([*kinds, f"`{name}` boolean"]))


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of each whole text."""
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
