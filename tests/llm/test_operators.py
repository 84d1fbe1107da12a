"""The text operators against plain versions, and their results on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from traceframe.llm import embedding_dedup, jaccard_join, language_id, packing, pseudonyms, quality_model, quality_rules, sentencepiece_codec, sharding, toxicity
from traceframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, _lang string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, None, None, None, None, "x", 0.1, "q"), (2, "", "en", "s", 0, None, None, None), (3, " \n\t ", "en", "s", 4, None, None, None),
    (4, "Ünïcode wörds — 漢字 😀 <s> </s> a 　 b", "de", "s", 1, None, None, None), (5, LONG, "en", None, 9, None, None, None),
    (6, LONG, "en", "s", 9, None, None, None), (6, LONG, "en", "s", 9, None, None, None), (None, "no id here but some words", "en", "s", 1, None, None, None), (7, "12345 !!", None, "t", 2, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_every_operator_has_its_query():
    assert [len([q for q in QUERIES if q.startswith(f"op{n}_")]) for n in range(1, 14)] == [1] * 13


# --- n-gram Jaccard join


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if common and 100 * common >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("seed,size", [(1, 9), (2, 40), (3, 160)])
def test_jaccard_components_of_edited_copies(spark, seed, size):
    random.seed(seed)
    passage = [f"p{i}" for i in range(size // 2)]
    rows = []
    for family in range(12):
        base = [random.choice("abcdefghijklm") + str(random.randrange(40)) for _ in range(size)]
        if family % 2:
            base[: len(passage)] = passage
        for _ in range(14):
            w = list(base)
            for _ in range(random.randrange(0, max(2, size // 15))):
                w[random.randrange(len(w))] = f"e{random.randrange(9999)}"
            if random.random() < 0.4:
                w = w[: random.randrange(len(w) // 2, len(w)) + 1]
            rows.append((len(rows), " ".join(w) if random.random() < 0.8 else " ".join(w).upper()))
    rows += [(len(rows) + i, t) for i, t in enumerate(["a b", "A  b", "a b c", "", None, "a b c d e", "a b c d e f"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_components(rows)
    assert {i: c for i, (_, c) in got.items()} == want
    assert all(got[i][0] == len(shingles(t)) for i, t in rows)


def test_jaccard_sets_that_ask_again(spark, monkeypatch):
    # one segment for all sizes: every set is short of segments and asks again under further hashes
    monkeypatch.setattr(jaccard_join, "SLACK", 1.0)
    rows = [(i, " ".join(f"{'abcdef'[(i + k * (i % 3)) % 6]}{k}" for k in range(7 + i % 5))) for i in range(60)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_jaccard_odd_rows(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()]
    assert len(got) == len(ODD) and (None, 2, None) in got
    found = {a: c for a, _, c in got}
    assert found[5] == found[6] == 5 and found[1] == 1 and found[2] == 2 and found[3] == 3
    assert jaccard_join.jaccard_components(none).count() == 0


# --- quality rules


def plain_stats(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    found = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if found[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_text_statistics(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = {(r.doc_id, r.text): r for r in docs.collect()}
    got = [tuple(r[3:]) for r in quality_rules.text_stats(docs).collect()]
    assert sorted(got) == sorted(plain_stats(t) for (_, t), n in Counter((r.doc_id, r.text) for r in docs.collect()).items() for _ in range(n)) and rows
    judged = quality_rules.quality_rules(odd).collect()
    assert len(judged) == len(ODD) and all(not r.kept for r in judged if r.doc_id in (1, 2, 3, 7))
    assert quality_rules.quality_rules(none).count() == 0


def test_outliers_are_rejected_and_ordinary_rows_kept(spark):
    random.seed(4)
    rows = [(i, " ".join(f"w{random.randrange(10**6)}" for _ in range(random.randrange(80, 300))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(f"w{random.randrange(10**6)}###" for _ in range(150)), "en", "s") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(20))


# --- classifiers


def test_toxicity_held_out(spark):
    got = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted[got.toxic == 0] == 0).mean() > 0.995 and (got.predicted[got.toxic == 1] == 1).mean() > 0.6


def test_language_held_out(spark):
    got = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.99 and got.score.between(0, 1).all()


def test_quality_held_out(spark):
    got = QUERIES["op7_quality_model"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.5) == got.quality).mean() > 0.95


def test_classifiers_on_odd_rows(spark, odd, none):
    labelled = odd.selectExpr("doc_id", "text", "doc_id % 2 label").where("doc_id is not null")
    model = toxicity.fit(labelled)
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model, name="score").collect()}
    assert len(scores) == 8 and scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(odd, toxicity.fit(labelled.where("label = 1")), name="score").where("score <> 0.5").count() == 0
    assert toxicity.score(none, model).count() == 0 and toxicity.score(odd, model).columns == [*odd.columns, "toxicity"]
    got = {r.doc_id: r for r in language_id.predict(odd, language_id.fit(odd)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and got[5].lang_pred == "en"
    assert {r.lang_pred for r in language_id.predict(odd, language_id.fit(none)).collect()} == {"und"}
    vectors = quality_model.word_vectors(odd)
    assert quality_model.score(odd, vectors, quality_model.fit(labelled, vectors)).count() == len(ODD)
    assert quality_model.score(odd, quality_model.word_vectors(none), None).where("quality <> 0.5").count() == 0


# --- tokens


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [[*e.ids, packing.END] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id <> 6"))
    docs = docs.selectExpr("row_number() over (order by doc_id, text) doc_id", "text").cache()
    rows = docs.collect()
    ids = dict(zip((r.doc_id for r in rows), reference_ids([r.text for r in rows])))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs.repartition(3)).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for held, total in [*((v, len(ids[k])) for k, v in pieces.items()), *((v, None) for v in windows.values())]:
        at = 0
        for start, length in sorted(held):
            assert start == at
            at += length
        assert at == total if total else at == packing.WINDOW or at & (at - 1) == 0
    assert set(pieces) == set(ids) and packing.pack(none).count() == 0
    assert packing.pack(odd).where("doc_id is null").count() == 1


def test_windows_go_to_the_level_with_least_squares():
    windows = packing.Windows(lambda _: None, 10)
    windows.counts[[3, 7]] = [2, 1]
    plain = {}
    for size in range(1, 10):
        for level in [0, 3, 7]:
            if level + size <= 10:
                n = windows.counts.copy()
                n[level] -= level > 0
                n[level + size] += level + size < 10
                plain.setdefault(size, {})[level] = int((n[1:10] ** 2).sum())
        assert plain[size][windows.level_for(size)] == min(plain[size].values())


def test_sentencepiece_parity_and_round_trip(spark, odd, none):
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(docs)).collect()
    assert all((r.ids or []) == own.encode(r.text or "") and r.decoded == r.text and r.round_trip for r in got)
    assert sentencepiece_codec.encode_texts(none).count() == 0 and sentencepiece_codec.encode_texts(odd).where("doc_id = 1 and ids is null and n_tokens = 0").count() == 1


# --- sharding


def test_shards_hold_the_mixture(spark, odd, none):
    docs = spark.createDataFrame([(i, f"t{i % 50}", None if i % 10 == 9 else "ab"[i % 3 == 0]) for i in range(1000)], "doc_id long, text string, source string")
    rows = sharding.interleave(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1000))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.size == len(f"t{r.doc_id % 50}") + 1 and r.text_crc32 == zlib.crc32(f"t{r.doc_id % 50}".encode())
    assert all(sorted(r.slot for r in v) == list(range(125)) for v in by.values()) and len(by) == 8
    for source in ("a", "b", None):
        n = [sum(r.source == source for r in v) for v in by.values()]
        assert max(n) - min(n) <= 1
    got = sharding.interleave(odd).collect()
    assert len(got) == len(ODD) and Counter(r.shard for r in got).most_common(1)[0][1] == 2 and sharding.interleave(none).count() == 0


# --- pseudonyms


def test_pseudonyms(spark, odd, none):
    text = "on 1984-02-29, 31.12.1999, 2023-13-01 card 4111 1111 1111 1111 not 4111 1111 1111 1112 ip 10.0.0.3 no 10.0.0.300 tel +1 (017) 555-7713 a.b@c.de password=e3b3ed3cc8548923d6"
    out = pseudonyms.pseudonymise(spark.createDataFrame([(1, text), (2, "4111 1111 1111 1111 again +1 (017) 555-7713")], "doc_id long, text string")).orderBy("doc_id").collect()
    a, b = out[0].text, out[1].text
    for gone in ("1984-02-29", "31.12.1999", "4111 1111 1111 1111 ", "10.0.0.3 ", "555-7713", "a.b@c.de", "e3b3ed3cc8548923d6"):
        assert gone not in a
    for stays in ("2023-13-01", "not 4111 1111 1111 1112", "10.0.0.300"):
        assert stays in a
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", a)[1]
    digits = [int(c) for c in card if c != " "][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert b.startswith(card) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a)[0] in b
    same = pseudonyms.pseudonymise(odd, name="score")
    assert {r.doc_id: r.text for r in same.collect()} == {r[0]: r[1] for r in ODD} and pseudonyms.pseudonymise(none).count() == 0


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    x, y = pseudonyms.feistel(F.floor(F.col("id") / 43), F.col("id") % 43, F.lit(17).cast("bigint"), F.lit(43).cast("bigint"), "t", "k")
    assert spark.range(17 * 43).select((x * 43 + y).alias("v")).distinct().where("v >= 0 and v < 731").count() == 731


# --- embeddings


def test_embedding_groups(spark):
    random = np.random.default_rng(2)
    base = random.normal(size=(60, 16))
    x = np.concatenate([base[i % 60] + random.normal(size=16) * random.choice([0, 0.05, 0.2, 0.35]) for i in range(700)]).reshape(-1, 16).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] + [None] * 15), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (None, rows[0][1])]
    got = {r.vec_id: r for r in embedding_dedup.near_groups(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), cell=40, block=16).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(700)
    for _ in range(700):
        label = np.minimum(label, np.where(linked, label[None, :], 700).min(1))
    for i in range(700):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), label[i], label[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 907)) and got[None].component_id is None and not got[None].kept
    assert embedding_dedup.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- pipeline


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns and docs.count() <= before.count(), name
    texts = {r.doc_id: r.text for r in docs.collect()}
    components = plain_components(sorted(texts.items()))
    assert all(i == c for i, c in components.items())
    ids = dict(zip(texts, reference_ids(texts.values())))
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.length for r in got) == sum(map(len, ids.values())) and {r.doc_id for r in got} == set(ids)
    assert sorted((r.doc_id, r.start, r.length) for r in got if r.start == 0) and corpus_pipeline.run(spark, SF).agg({"length": "sum"}).first()[0] == sum(map(len, ids.values()))
