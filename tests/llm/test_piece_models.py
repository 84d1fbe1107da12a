"""Unigram and merge models against the sentencepiece package. The models are written by hand, not trained."""

import random

import numpy as np
import pytest
import sentencepiece

from traceframe.llm import sentencepiece_codec as codec
from traceframe.llm.spans import Texts

PIECES = "▁ ▁▁ a b c d e ▁a ▁b ab abc bc de ▁de cde $ $$ $$$ ▁the the é 漢 ▁漢 aé ▁▁a .".split()
TEXTS = ["", " ", "   ", "a", " a", "a ", "  a  b  ", "abcde", "<unk> a </s>", "<s>", "<0x41>", "x", "xyz a", "漢字 a", "é e", "the abc  de", "▁a", "a▁", "a\tb\nc", "uuu<user> a", "<user>", "ab<user>cd", "😀😀 a", "\x00a", "a" * 3000]


def number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def item(tag: int, value) -> bytes:
    if isinstance(value, bytes):
        return number(tag << 3 | 2) + number(len(value)) + value
    if isinstance(value, float):
        return number(tag << 3 | 5) + np.float32(value).tobytes()
    return number(tag << 3) + number(int(value))


def model(kind: int, fallback: bool, extra: bool, prefix: bool, user: bool = False) -> bytes:
    rows = [("<unk>", 0.0, codec.UNKNOWN), ("<s>", 0.0, codec.CONTROL), ("</s>", 0.0, codec.CONTROL)]
    rows += [(f"<0x{b:02X}>", 0.0, codec.BYTE) for b in range(256)] if fallback else []
    rows += [("<user>", 0.0, codec.USER)] if user else []
    # scores are sums of powers of two, so equal sums are equal in single and double precision
    rows += [(p, -2.0 - (i * 7 % 11) / 4 if kind == codec.UNIGRAM else -float(i), codec.NORMAL) for i, p in enumerate(PIECES)]
    rows += [("xyz", -1.0, codec.UNUSED)] if kind == codec.UNIGRAM else []
    out = b"".join(item(1, item(1, p.encode()) + item(2, s) + item(3, k)) for p, s, k in rows)
    return out + item(2, item(3, kind) + item(35, fallback)) + item(3, item(3, prefix) + item(4, extra) + item(5, True))


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("extra", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("kind", [codec.UNIGRAM, codec.BPE])
def test_ids_and_texts_are_those_of_the_package(kind, fallback, extra, prefix):
    data = model(kind, fallback, extra, prefix)
    own, other = codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    dice = random.Random(3)
    texts = TEXTS + ["".join(dice.choice(["a", "b", "c", "d", "e", " ", "  ", "$", "$$", "the", "é", "漢", "x", "<s>", "."]) for _ in range(dice.randrange(40))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    got = own.encode(Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    wrong = [(t, list(g), other.encode(t)) for t, g in zip(texts, got) if list(g) != other.encode(t)]
    assert not wrong, wrong[:3]
    for _ in range(200):
        got.append(np.array([dice.randrange(other.get_piece_size()) for _ in range(dice.randrange(6))], np.int32))
    texts = [(g, codec.as_text(own.decode(g.astype(np.int64))), other.decode([int(i) for i in g])) for g in got]
    assert not [t for t in texts if t[1] != t[2]], [t for t in texts if t[1] != t[2]][:3]


def test_user_pieces_win():
    data = model(codec.UNIGRAM, True, True, True, user=True)
    own, other = codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert [list(x) for x in own.whole(TEXTS)] == [other.encode(t) for t in TEXTS]


def test_ids_outside_the_vocabulary_and_refused_models():
    own = codec.Codec(model(codec.UNIGRAM, True, True, True))
    assert own.decode(np.array([-1, 10**6])).decode() == " ⁇  ⁇ "
    assert own.decode(np.zeros(0, np.int64)) == b""
    with pytest.raises(ValueError):
        codec.build(codec.Model(pieces=[("a", -1.0, codec.NORMAL)]))


def test_verify(spark):
    docs = spark.createDataFrame([(1, "Some words, 12 of them."), (2, ""), (3, None)], "doc_id bigint, text string")
    got = codec.verify(codec.encode_texts(docs)).select("doc_id", "parity").collect()
    assert sorted((r.doc_id, r.parity) for r in got) == [(1, True), (2, True), (3, None)]
    bad = codec.encode_texts(docs).withColumn("ids", codec.F.expr("if(doc_id = 1, array(5, 6), ids)"))
    assert codec.verify(bad).where("doc_id = 1").first().parity is False
    lists = spark.createDataFrame([(1, [None, -4, 10**8]), (2, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in codec.decode_ids(lists).collect()} == {1: " ⁇  ⁇  ⁇ ", 2: None}
