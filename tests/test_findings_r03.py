"""Findings of the third review: memory of one task does not grow with what a table says of its size."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from traceframe.operators import ordered, search, validate

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["j02_containing_function", "j03_preview_range", "j05_changed_line_issues"])
def test_derived_rows_are_not_sent_to_every_task(spark, name):
    text = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_places_are_sorted_once_and_not_made_distinct_first(spark):
    text = contract.queries()["j02_containing_function"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert " HashAggregate" not in text


def test_repeated_and_null_places(spark):
    places = spark.createDataFrame([(1, "a.py", 5), (1, "a.py", 5), (2, "a.py", None), (3, None, 5), (4, "a.py", 64), (5, "a.py", 300)], "id long, file string, line int")
    funcs = spark.createDataFrame([("a.py", 1, 200, "outer"), ("a.py", 4, 64, "inner"), (None, 1, 9, "lost")], "file string, line_start int, line_end int, name string")
    found = search.containing_function(places, funcs, ["id"]).orderBy("id").collect()
    assert [(r.id, r.function, r.line_start) for r in found] == [(1, "inner", 4), (2, None, None), (3, None, None), (4, "inner", 4), (5, None, None)]


def test_changed_lines_at_the_edges_of_buckets(spark):
    issues = spark.createDataFrame([("a.py", f"line {n} W291") for n in (61, 62, 63, 64, 66, 67, 2147483647)] + [("a.py", "no place"), ("b.py", "line 64 x"), (None, "line 64 x")], "file string, message string")
    changed = spark.createDataFrame([("a.py", 64), ("a.py", 64), ("a.py", 65), ("a.py", None), (None, 64), ("a.py", 2147483647)], "file string, line int")
    kept = sorted(r.line for r in validate.near_changes(issues, changed).where("line is not null").collect())
    assert kept == [62, 63, 64, 66, 67, 2147483647]
    assert validate.near_changes(issues, changed).where("line is null").count() == 1


def test_context_meets_one_row_a_hit(spark):
    rows = spark.createDataFrame([("a", p, f"t{p}") for p in range(1, 200) if p not in (130, 131)] + [("b", 3, "x"), (None, 1, "y")], "k string, p long, t string")
    hits = spark.createDataFrame([("a", 1, "h"), ("a", 64, "h"), ("a", 66, "h"), ("a", 66, "again"), ("a", 132, "h"), ("b", 2, "h"), ("b", 5, "h"), ("c", 1, "h"), (None, 1, "h")], "k string, p long, w string")
    found = ordered.context_before(hits, rows, ["k"], "p", F.col("t"), 4, "c")
    assert found.columns == ["k", "p", "w", "c"]
    # hits are neither multiplied nor grouped; rows meet them once
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Join") == 1 and text.count("Generate") == 1
    got = {(r.k, r.p, r.w): r.c for r in found.collect()}
    assert got == {
        ("a", 1, "h"): ["t1"], ("a", 64, "h"): ["t61", "t62", "t63", "t64"], ("a", 66, "h"): ["t63", "t64", "t65", "t66"], ("a", 66, "again"): ["t63", "t64", "t65", "t66"],
        ("a", 132, "h"): ["t129", "t132"], ("b", 2, "h"): None, ("b", 5, "h"): ["x"], ("c", 1, "h"): None, (None, 1, "h"): None,
    }
