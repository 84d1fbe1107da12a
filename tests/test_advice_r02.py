"""Cases of the review: results that were cut, dropped or left in clear text."""

import json

import __spark_entry__ as contract
from pyspark.sql import functions as F
from tests.harness import compare, duck
from traceframe.operators import code, edits


def test_file_list_beyond_its_limit(spark):
    sf = "/root/testdata/sf0.01"
    con, made, sql = duck(sf), contract.queries(), contract.oracle_sql()
    for name in ("f27_file_list", "f27_file_list_all"):
        assert compare(made[name](spark, sf), con, sql[name]) is None
    assert made["f27_file_list"](spark, sf).count() == 100 < made["f27_file_list_all"](spark, sf).count()


def test_edit_of_lines_that_a_file_does_not_have(spark):
    files = spark.createDataFrame([("a", "a"), ("b", ""), ("c", "a\nb\na"), ("d", "x\n")], "file string, text string")
    asked = files.select("file", F.lit("a").alias("search"), F.lit("z").alias("replacement"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    done = {r.file: (r.text, r.status) for r in edits.replace_in_range(files, asked).collect()}
    assert done == {"a": ("a", "not_found"), "b": ("", "not_found"), "c": ("a\nb\nz", "replaced"), "d": ("x\n", "not_found")}


def test_every_document_is_edited_in_its_range(spark):
    sf = "/root/testdata/sf0.01"
    made = contract.queries()["e05_replace_in_range_all"](spark, sf)
    assert compare(made, duck(sf), contract.oracle_sql()["e05_replace_in_range_all"]) is None
    assert made.count() == spark.read.parquet(f"{sf}/documents.parquet").count() > contract.queries()["e05_replace_in_range"](spark, sf).count()


def test_export_has_every_file_a_summary_and_the_graph(spark, tmp_path):
    texts = [("a.py", "def f():\n    g()\n    g()\n"), ("constants.py", "LIMIT = 3\n"), ("empty.py", "")]
    files = spark.createDataFrame(texts, "path string, text string")
    facts = code.syntax_facts(files).cache()
    assert {r.path: len(json.loads(r.value)) for r in code.summary_export(files, facts).collect()} == {"a.py": 1, "constants.py": 0, "empty.py": 0}
    code.write_analysis(files, facts, str(tmp_path / "o"))
    back = {n: [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/o/section={n}").collect()] for n in ("summary", "files", "graph")}
    assert back["graph"] == [{"caller": "f", "callee": "g"}] and sorted(r["path"] for r in back["files"]) == ["a.py", "constants.py", "empty.py"]
    assert len(back["summary"]) == 1 and (back["summary"][0]["files"], back["summary"][0]["functions"]) == (3, 1)
