"""Cases that caps, shared keys or a common clock used to lose."""

import json

from pyspark.sql import functions as F

from traceframe.operators import code, edits, mail, search
from traceframe.sinks import files as file_sinks
from traceframe.sinks import streaming as sinks
from traceframe.sources import records
from traceframe.streaming import live
from traceframe.streaming.carry import Carry


def test_field_first_seen_in_a_late_record(spark, tmp_path):
    rows = [{"id": i} for i in range(40)] + [{"id": 40, "late": "x"}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    merged = records.scan_nested(spark, {"a": str(tmp_path / "a.json")})
    assert merged.where("late = 'x'").count() == 1
    assert "late" not in records.sampled_schema(spark, str(tmp_path / "a.json"), rows=10).fieldNames()


def test_long_terms_and_terms_with_signs(spark):
    rows = spark.createDataFrame([(1, "see a/b=c"), (2, "y" * 60), (3, "other")], "id int, bodyText string")
    assert [r.id for r in rows.where(mail.search({"body": "a/b="})).collect()] == [1]
    assert [r.id for r in rows.where(mail.search({"body": "y" * 60})).collect()] == [2]


def test_calls_far_below_their_function(spark):
    text = "def f():\n" + "".join(f"    g{i}()\n" for i in range(150)) + "h()\n"
    files = spark.createDataFrame([("a.py", text)], "path string, text string")
    assert search.calls_from(files, "f").count() == 150


def test_context_lines_are_kept(spark, tmp_path):
    events = spark.createDataFrame([("u", [str(i) for i in range(30)])], "url string, context_lines array<string>").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    file_sinks.write_json_lines(events, str(tmp_path / "o"))
    assert len(spark.read.json(str(tmp_path / "o")).first().context_lines) == 30


def test_edits_of_a_file_in_order(spark):
    files = spark.createDataFrame([("a", "aa bb"), ("b", "x\ny\nx")], "file string, text string")
    asked = spark.createDataFrame([("a", 1, "aa", "11"), ("a", 2, "11 bb", "22"), ("b", 1, "x", "z"), ("c", 1, "q", "r")], "file string, seq int, search string, replacement string")
    done = {(r.file, r.seq): (r.text, r.replaced) for r in edits.replace_all(files, asked).collect()}
    assert done == {("a", 1): ("22", 1), ("a", 2): ("22", 1), ("b", 1): ("z\ny\nz", 2), ("c", 1): (None, None)}
    first = {(r.file, r.seq): (r.text, r.status) for r in edits.replace_first(files, asked).collect()}
    assert first == {("a", 1): ("22", "replaced"), ("a", 2): ("22", "replaced"), ("b", 1): ("z\ny\nx", "multiple"), ("c", 1): (None, "no_file")}
    ranged = asked.withColumns({"start_line": F.lit(2), "end_line": F.lit(3)}).where("file = 'b'")
    assert edits.replace_in_range(files, ranged).first().text == "x\ny\nz"


def test_every_definition_with_its_own_branches(spark):
    text = "class A:\n    @property\n    def v(self):\n        return 1\n    @v.setter\n    def v(self, x):\n        if x:\n            pass\n        if not x:\n            pass\n"
    facts = code.syntax_facts(spark.createDataFrame([("a.py", text)], "path string, text string"))
    assert sorted((r.line_start, r.complexity) for r in code.functions(facts).collect()) == [(3, 1), (6, 3)]


def test_live_alert_of_a_lagging_key(spark, tmp_path):
    run = live.live_trailing_alerts(sinks.folder(str(tmp_path / "o")), Carry(str(tmp_path / "c")), ["k"], "ts", 300, 2)
    for n, rows in enumerate(([("A", 1000), ("B", 20000)], [("A", 1100)])):
        run(spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")), n)
    assert [(r.k, r.n_recent) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("A", 2)]
