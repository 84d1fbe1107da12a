"""Operators whose pairs SQL can express, against their SQL on whole tables and on rows made for it."""

import pytest
from pyspark.sql import functions as F

from tests.harness import compare, duck
from traceframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op2_embedding_dedup", "op5_jaccard_join"])
def test_given_tables(spark, name):
    assert compare(QUERIES[name](spark, "/root/testdata/sf0.01"), duck("/root/testdata/sf0.01"), ORACLES[name]) is None


def test_vectors_at_and_below_the_threshold(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [0.9, 0.44]), (3, [0.9, 0.43]), (4, [0.0, 2.0]), (5, [0.1, 2.0]), (6, [0.0, 0.0]), (7, None), (8, [nan, 1.0]),
        (9, [inf, 1.0]), (10, [1.0, 0.0]), (11, [1.0]), (12, []), (13, [1.0, None]), (14, [3.0]),
    ]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duck(str(tmp_path))
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare(QUERIES["op2_embedding_dedup"](spark, str(tmp_path)), con, ORACLES["op2_embedding_dedup"]) is None


def test_texts_around_the_threshold(spark, tmp_path):
    body = [f"w{i}" for i in range(60)]
    texts = [None, "", " \n", "a b c", "A  b\tC", "a b c d", "É é", "é é"]
    texts += [" ".join(body[:n] + [f"x{k}{i}" for i in range(60 - n)]) for k, n in enumerate([60, 60, 53, 52, 51, 50, 49, 48, 47])]
    rows = list(enumerate(texts, 1))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duck(str(tmp_path))
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(QUERIES["op5_jaccard_join"](spark, str(tmp_path)), con, ORACLES["op5_jaccard_join"]) is None
