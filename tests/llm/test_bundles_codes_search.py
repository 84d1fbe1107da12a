"""WARC bundles, vector codes and lexical search against plain versions, and their results on odd rows."""

import base64
import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.harness import compare, duck
from traceframe.llm import lexical_search, vector_codes, warc_bundles
from traceframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_warc_bundles", "op12_vector_codes", "op13_lexical_search"])
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


# --- WARC bundles

PAGES = "page_id long, url string, html string, record_id string, size long, payload string, frame int"
ROWS = [
    (1, "http://a/ü b?x=1\r\ny", "same", "q", 1, "z", 1), (2, None, "same", None, None, None, None), (3, "http://c", None, "q", 1, "z", 1), (4, "http://d", "", "q", 1, "z", 1),
    (5, "http://e", "WARC/1.1\r\n\r\nü漢😀", "q", 1, "z", 1), (5, "http://e", "WARC/1.1\r\n\r\nü漢😀", "q", 1, "z", 1), (None, "http://n", "same", "q", 1, "z", 1), (6, "http://f", "x" * 700_000, "q", 1, "z", 1), (None, None, "alone", None, 1, None, 1),
]


def test_bundles_of_odd_pages(spark, tmp_path):
    folder = str(tmp_path / "b")
    index = warc_bundles.write_bundles(spark.createDataFrame(ROWS, PAGES), folder)
    got = warc_bundles.read_bundles(spark, folder).collect()
    assert len(got) == len(ROWS) == index.count()
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    for page, _, html, *_ in ROWS:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert any((r.payload_bytes, r.payload_digest) == (len(payload), digest) for r in by[page])
    assert [(r.record_type, r.refers_to, r.payload) for r in by[1]] == [("revisit", 2, None)] and by[2][0].payload == "same"
    assert by[3][0].refers_to == 4 and by[4][0].payload == "" and sorted(r.record_type for r in by[5]) == ["response", "revisit"]
    assert {(r.record_type, r.refers_to, r.payload) for r in by[None]} == {("revisit", 2, None), ("response", None, "alone")}
    assert len({r.record_id for r in got if r.page_id == 5}) == 2


def test_one_record_from_one_frame(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i % 40} " * 50) for i in range(200)], "page_id long, url string, html string").repartition(3)
    index = warc_bundles.write_bundles(pages, folder, frame=2000, bundle=5000)
    assert index.select("bundle").distinct().count() > 3 and index.agg({"frame": "max"}).first()[0] > 1
    got = {r.page_id: r for r in warc_bundles.fetch(spark, folder, spark.createDataFrame([(3,), (170,), (999,), (3,), (None,)], "page_id long")).collect()}
    assert set(got) == {3, 170} and got[3].record_type == "revisit" and got[3].payload == "page 3 " * 50 and got[170].payload == "page 10 " * 50
    # what a lost task left behind does not count
    store, path = warc_bundles.filesystem(folder)
    stray = warc_bundles.BundleWriter(store, f"{path}/stray.warc.zst")
    stray.add(warc_bundles.make_record(77, 0, None, b"x", 1, warc_bundles.payload_digest(b"x"), None, "1970-01-01T00:00:00Z"))
    stray.close()
    assert warc_bundles.read_bundles(spark, folder).count() == 200 and warc_bundles.remove_orphans(spark, folder) == 1 and not os.path.exists(f"{path}/stray.warc.zst")


def test_small_payloads_are_all_stored_and_damage_is_found(spark, tmp_path):
    folder = str(tmp_path / "b")
    pages = spark.createDataFrame([(i, None, "ab" if i < 5 else "abc") for i in range(9)], "page_id long, url string, html string")
    warc_bundles.write_bundles(pages, folder, least_bytes=3)
    got = warc_bundles.read_bundles(spark, folder).collect()
    assert sorted(r.page_id for r in got if r.record_type == "response") == [0, 1, 2, 3, 4, 8]
    empty = str(tmp_path / "e")
    warc_bundles.write_bundles(pages.limit(0), empty)
    assert warc_bundles.read_bundles(spark, empty).count() == 0 and warc_bundles.remove_orphans(spark, empty) == 0
    store, path = warc_bundles.filesystem(folder)
    name = next(x for x in os.listdir(path) if x.endswith(".zst"))
    raw = bytearray(open(f"{path}/{name}", "rb").read())
    raw[30] ^= 1
    open(f"{path}/{name}", "wb").write(raw)
    with pytest.raises(Exception):
        warc_bundles.BundleReader(store, f"{path}/{name}").frame(0)


# --- vector codes


def plain_codes(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: r[0])
    x = np.array([[math.floor(256 * v) for v in e] for _, e in rows], np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for at in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        own = d.argmin(2)
        if at < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    some = x[own[:, p] == e, p]
                    if len(some):
                        books[p, e] = some.sum(0) // len(some)
    return {r[0]: (bytes(own[i].astype(np.uint8)).hex(), int(d[i].min(1).sum())) for i, r in enumerate(rows)}, hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()


@pytest.mark.parametrize("seed,entries,rounds,spread", [(1, 64, 2, 1.0), (2, 16, 6, 0.02), (3, 3, 4, 5.0), (4, 256, 3, 0.3), (5, 1, 2, 1.0)])
def test_codes_equal_plain_ones(spark, seed, entries, rounds, spread):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(20, 32))
    x = (centres[random.integers(0, 20, 900)] + random.normal(size=(900, 32)) * spread).astype(np.float32)
    x[::7] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id % 3 label").repartition(4), parts=16, entries=entries, rounds=rounds).collect()
    want, digest = plain_codes(rows, 16, entries, rounds)
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    per = Counter()
    for r in got:
        per[r.label] += r.error
    assert all(r.label_error == per[r.label] for r in got)


def test_bounds_leave_most_entries_alone():
    random = np.random.default_rng(6)
    x = np.floor(random.normal(size=(2000, 4)) * 40).astype(np.int64)
    before = x[:64].copy()
    after = before + random.integers(-2, 3, before.shape)
    near, _, bounds = vector_codes.Book(before[None]).compare_all(x, 0, 8)
    new, exact, lower, depth = vector_codes.Book(after[None], before[None]).reassign(x, 0, near, vector_codes._stored(bounds).astype(float), 5)
    d = vector_codes._distances(x, after)
    assert (new[:, 0] == d.argmin(1)).all() and (exact == d.min(1)).all() and np.median(depth) <= 2
    true = np.sqrt(d.astype(float))
    for i in range(0, 2000, 17):  # every bound holds for its entry and all further ones
        rest = set(range(64)) - {int(new[i, 0])}
        for k in range(6):
            assert lower[i, k] <= min((true[i, e] for e in rest), default=np.inf) + 1e-6
            rest -= {int(new[i, k + 1])} if k < 5 else set()


def test_codes_of_odd_vectors(spark):
    v = [0.5, -0.25] * 8
    kind = "vec_id long, embedding array<double>, label string, code string, error long, v array<int>"
    rows = [(1, v, None, "q", 1, None), (2, None, "a", "q", 1, None), (3, [None] * 16, "a", "q", 1, None), (4, [float("nan")] * 16, "a", None, 1, None), (5, [float("inf")] * 16, "a", None, 1, None)]
    rows += [(6, [1.0] * 15, "a", None, 1, None), (7, [], "a", None, 1, None), (8, [1e300] * 16, "b", None, 1, None), (9, v, None, None, 1, None), (9, v, "a", None, 1, None), (None, [1.0] * 16, "b", None, 1, None)]
    got = vector_codes.compress(spark.createDataFrame(rows, kind)).collect()
    assert Counter(r.vec_id for r in got) == Counter([1, 6, 7, 8, 9, 9, None])
    assert {r.vec_id for r in got if r.code is None} == {6, 7, 8} and all(r.error == 0 for r in got if r.code)
    assert {r.label_error for r in got if r.vec_id in (1, 9)} == {0}
    assert vector_codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert [r.code for r in vector_codes.compress(spark.createDataFrame([(1, [1.0] * 3, "x")], "vec_id long, embedding array<double>, label string")).collect()] == [None]


# --- lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, top):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, bag, size in bags:
            m = 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in words if bag[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, at + 1, None if none else i, -s) for at, (s, none, i) in enumerate(sorted(found)[:top])]
    return Counter(out)


@pytest.mark.parametrize("seed,top,block", [(1, 50, 1 << 18), (2, 7, 30)])
def test_search_equals_plain_one(spark, seed, top, block):
    random.seed(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "漢字", "x y", "a_b", "A1"]
    texts = [" ".join(random.choice(words) for _ in range(random.choice([1, 2, 3, 30]))) for _ in range(120)]
    docs = [(i, random.choice(texts)) for i in range(700)] + [(1000 + i, "W1 w2") for i in range(90)]
    docs += [(5000, None), (5001, ""), (5002, " -_- "), (7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2"), (None, "w3"), (5003, "w1 " * 50_000)]
    items = [(i, " ".join(random.choice(words) for _ in range(12))) for i in range(12)] + [(20, None), (21, "..."), (22, "nowhere"), (3, "w5 w6"), (None, "W3 w1")]
    frame = spark.createDataFrame([(*d, "q", 1) for d in docs], "doc_id long, text string, terms string, n int").repartition(5)
    got = lexical_search.search(frame, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"), top=top, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items, top)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    some = spark.createDataFrame([(1, 1, "a b")], "doc_id long, item_id long, text string")
    assert [lexical_search.search(a, b).count() for a, b in ((none, some), (some, none), (none, none))] == [0, 0, 0]
    assert lexical_search.search(some.selectExpr("doc_id", "cast(null as string) text"), some).count() == 0
