"""Cases of the second review: lengths of vectors, one-label models, robust estimates, clashing names, repeated rows."""

import math
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from traceframe.llm import embedding_dedup, quality_rules, toxicity
from traceframe.llm.common import labelled_sample, unused
from traceframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_links_of_all_vector_lengths(spark):
    random = np.random.default_rng(1)
    rows = []
    for size in range(1, 71):
        v = random.normal(size=size)
        rows += [(len(rows), [float(x) for x in v]), (len(rows) + 1, [float(x) * 2 for x in v])]
    got = embedding_dedup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.n_links >= 1 and r.component_id <= r.vec_id // 2 * 2 for r in got) and len(got) == 140
    assert all(r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in got if r.vec_id >= 2)


def test_many_centres(spark):
    random = np.random.default_rng(2)
    x = np.repeat(random.normal(size=(1500, 8)), 3, 0) + random.normal(size=(4500, 8)) * 0.05
    got = {r.vec_id: r for r in embedding_dedup.near_groups(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>"), cell=3, block=64).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in range(4500)] == linked.sum(1).tolist()


def test_centres_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELLS", 8)
    random = np.random.default_rng(3)
    rows = [(i, [float(v) for v in random.normal(size=2 + i % 30)]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("weight", F.lit(1).cast("long"))
    assert sum(map(len, embedding_dedup._centres(frame, 10).values())) <= 16
    rows = [(i, [float(v) for v in random.normal(size=3)]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("weight", F.lit(1).cast("long"))
    assert list(map(len, embedding_dedup._centres(frame, 10).values())) == [8]


def test_predictions_follow_scores(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of words") for i in range(200)], "doc_id long, text string")
    for name, value in (("toxic", "1"), ("clean", "0"), ("mixed", "cast(doc_id % 2 = 0 as int)"), ("nothing", "cast(null as int)")):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        docs.selectExpr("doc_id", f"{value} as toxic", f"{value} as quality").write.parquet(f"{folder}/labels.parquet")
        for query in ("op1_toxicity", "op7_quality_model"):
            got = QUERIES[query](spark, folder).collect()
            assert len(got) == 200 and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
            assert name == "mixed" or query == "op7_quality_model" or not any(r.predicted for r in got)


def test_sampled_labels_carry_their_texts(spark):
    docs = spark.createDataFrame([(i % 90, f"t{i}") for i in range(100)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 120)] + [(3, 0), (None, 1), (4, 5), (7, None)], "doc_id long, toxic int")
    rows, counts = labelled_sample(docs, labels, "toxic", 5, 0, 1000, 1)
    all_rows, bounded = rows.collect(), labelled_sample(docs, labels, "toxic", 5, 0, 5, 1)[0].count()
    assert Counter(r.label for r in all_rows) == Counter(counts) and all(r.label == r.doc_id % 2 for r in all_rows)
    assert 0 < bounded < 40 and toxicity.fit(rows, counts={0: 3})[2] == 0.0


def plain_estimate(x, support, floors):
    p, n = x.shape[1], len(x)
    inner = quality_rules.chi_square_cut(support, p)
    scale = support / quality_rules._chi_square_share(inner, p + 2)
    floor = np.diag(np.square(floors))
    quartile = np.sort(x, 0)[[max(0, math.ceil(q * n) - 1) for q in (0.25, 0.5, 0.75)]]
    spread = np.maximum(((quartile[2] - quartile[0]) / 1.349) ** 2, np.square(floors))
    signs = (x - quartile[1]) / np.sqrt(spread)
    signs = quartile[1] + (x - quartile[1]) / np.maximum(np.linalg.norm(signs, axis=1, keepdims=True), 1e-9) * math.sqrt(p)
    starts = [(quartile[1], np.diag(1 / spread))] + [(y.mean(0), np.linalg.inv(np.cov(y.T, bias=True) + floor)) for y in (x, signs)]
    best = None
    for mean, inverse in starts:
        was = np.inf
        for _ in range(30):
            d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
            inside = x[d <= np.sort(d)[max(0, math.ceil(support * n) - 1)]]
            cov = np.cov(inside.T, bias=True) * scale + floor
            mean, inverse, det = inside.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
            if not det < was - 1e-4:
                break
            was = det
        if best is None or det < best[0]:
            best = det, mean, inverse
    return best


def test_robust_estimates_equal_plain_ones(spark):
    random = np.random.default_rng(5)
    rows = []
    for group, spread, far in (("a", 1.0, 4.0), ("b", 0.3, 9.0)):
        x = random.normal(size=(400, 5)) @ random.normal(size=(5, 5)) * spread
        x[:60] = random.normal(size=(60, 5)) * 0.1 + far
        rows += [(group, *map(float, r)) for r in x]
    frame = spark.createDataFrame(rows, ["own", *quality_rules.FEATURES])
    got = {r._g: r for r in quality_rules.estimates(frame, F.array(F.col("own"), F.lit("*"))).collect()}
    assert set(got) == {"a", "b", "*"} and got["*"]._rows == 800
    for group in "ab":
        x = np.array([r[1:] for r in rows if r[0] == group])
        _, mean, inverse = plain_estimate(x, 0.75, quality_rules.FLOORS)
        assert np.allclose(got[group]._mean, mean, atol=1e-6) and np.allclose(np.array(got[group]._inverse).reshape(5, 5), inverse, rtol=1e-5, atol=1e-6)
        # the planted tenth lies far out
        d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
        assert d[:60].min() > d[60:].max()


def test_groups_without_names_and_small_ones_are_judged(spark):
    made = [(i, " ".join(f"w{(i * 7 + k) % 997}x{k}" for k in range(60 + i % 40)), None if i % 2 else "en", None if i % 3 else f"s{i % 9}", "mine", 7.0) for i in range(300)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, _g string, distance double")
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == 300 and sum(r.kept for r in got) > 290
    only_bad = quality_rules.quality_rules(docs.withColumn("text", F.lit("a"))).collect()
    assert all(r.base_failed and not r.kept and r.distance == 0 for r in only_bad)


CLASHES = ("_lang", "_sure", "_toxic", "_values", "_found", "_n_private", "_rest", "_twice", "component_id", "n", "node", "label", "lang_pred", "score")


def test_stages_on_odd_rows_and_clashing_names(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    mail = "write to jane.doe@example.com about the meeting on Monday please and bring the papers"
    same = "this very sentence is repeated in several rows of the table with equal words"
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, long), (5, same), (5, same), (6, same + " again"), (None, same), (None, same), (7, mail), (8, "a b"), (8, "another text of the same id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            got = out.collect()
            assert out.columns == docs.columns and all(r[c] == f"mine {c}" for r in got for c in CLASHES), name
            assert table is docs or not got
        assert corpus_pipeline.pack_tokens(spark, table, SF).where("doc_id = 4").count() == (0 if table is not docs else corpus_pipeline.pack_tokens(spark, docs.where("doc_id = 4"), SF).count())
    kept = Counter(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert kept == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 1, 7: 1, 8: 2})
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}.isdisjoint({1, 2, 3})
    hidden = {r.doc_id: r for r in corpus_pipeline.hide_personal_data(spark, docs, SF).collect()}
    assert "jane.doe" not in hidden[7].text and hidden[7].n_chars == len(hidden[7].text) and hidden[1].text is None and hidden[2].text == ""


def test_unused_names(spark):
    assert unused(spark.createDataFrame([], "_A int, __a int"), "_a", "_a", "b") == ["___a", "____a", "b"]
