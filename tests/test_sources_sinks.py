"""Scans from files, sinks to files, micro-batch sinks and hooks."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from traceframe.functions import coerce
from traceframe.operators import checks, code, validate
from traceframe.sinks import files
from traceframe.sinks import streaming as sinks
from traceframe.sources import code_files, records, text_lines


def test_line_scan_over_blocks(spark, tmp_path):
    lines = [f"line {i}" if i % 5 else "   " for i in range(4000)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    (tmp_path / "b.log").write_bytes(b"caf\xe9 ok\r\n\n\nlast without end")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = text_lines.scan_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    a = {r.line_no: r.line for r in found if r.file.endswith("a.log")}
    kept = [x for x in lines if x.strip()]
    assert a == {i: x for i, x in enumerate(kept, 1)}
    b = {r.line_no: r.line for r in found if r.file.endswith("b.log")}
    assert b[1].startswith("caf� ok") and b[2] == "last without end" and len(b) == 2


def test_line_rules(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n")], "id int, text string")
    newline = text_lines.split_lines(df, "text").orderBy("line_no")
    assert [r.line for r in newline.collect()] == ["a\r", "b\rc", ""]
    split = text_lines.split_lines(df, "text", "splitlines").orderBy("line_no")
    assert [r.line for r in split.collect()] == ["a", "b", "c"]


def test_file_scan(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/deep/b.py": b"s = '\xe9'\n", "tests/test_a.py": b"", "src/c.txt": b"no"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = {r.path: r.text for r in code_files.scan_files(spark, str(tmp_path), exclude=["test*"]).collect()}
    assert found == {"src/a.py": "x = 1\n", "src/deep/b.py": "s = 'é'\n"}
    flat = code_files.scan_files(spark, str(tmp_path / "src"), recursive=False).collect()
    assert [r.path for r in flat] == ["a.py"]


def test_sampled_schema_and_scan(spark, tmp_path):
    for box in ("x", "y"):
        rows = [{"id": f"{box}{i}", "from": {"emailAddress": {"address": f"{i}@e.org"}}, "to": [{"name": "n"}]} for i in range(12)]
        (tmp_path / f"{box}.json").write_text("\n".join(map(json.dumps, rows)))
    boxes = {b: str(tmp_path / f"{b}.json") for b in ("x", "y")}
    merged = records.scan_nested(spark, boxes)
    assert merged.count() == 24 and {r.mailbox for r in merged.select("mailbox").distinct().collect()} == {"x", "y"}
    assert merged.select("from.emailAddress.address").first()[0].endswith("@e.org")
    assert records.scan_nested(spark, boxes, limit=7).count() == 7
    assert len(records.sampled_schema(spark, str(tmp_path / "missing.json")).fields) == 0


def test_catalog(spark):
    catalog = records.Catalog(spark, {"one_row": spark.range(1)})
    assert "one_row" in catalog.names() and catalog.table("one_row").count() == 1
    with pytest.raises(KeyError):
        catalog.table("no_such_table")


def failures(spark):
    row = ("https://a/", 1_700_000_000, "boom", "HTTPStatusError", ["c1", "c2", "c3", "c4"], 503, "x" * 1200)
    other = ("https://b/", 1_700_000_060, "slow", "ConnectTimeout", [], None, None)
    shape = "url string, s long, exception string, exception_type string, context_lines array<string>, response_status int, body string"
    return spark.createDataFrame([row, other], shape).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_json_exports(spark, tmp_path):
    events = failures(spark)
    files.write_json_lines(events, str(tmp_path / "lines"))
    back = spark.read.json(str(tmp_path / "lines")).orderBy("url").collect()
    assert [r.url for r in back] == ["https://a/", "https://b/"] and back[0].ts == "2023-11-14T22:13:20.000000"
    assert files.write_json_array(events, str(tmp_path / "array"), ["url"]) == 2
    (part,) = glob.glob(str(tmp_path / "array" / "part-*"))
    data = json.loads(open(part).read())
    assert [d["url"] for d in data] == ["https://a/", "https://b/"] and data[0]["context_lines"] == ["c1", "c2", "c3", "c4"]
    with pytest.raises(ValueError):
        files.write_json_array(events, str(tmp_path / "never"), ["url"], limit=1)
    assert files.write_json_array(events.limit(0), str(tmp_path / "none"), ["url"]) == 0


def test_text_report_and_folders(spark, tmp_path):
    events = failures(spark)
    text = {r.value.split("] ")[1].split("\n")[0]: r.value for r in files.text_report(events).collect()}
    assert text["https://a/"].split("\n")[1:] == [
        "  Exception: HTTPStatusError - boom", "  Response Status: 503", "  Context:", "    c2", "    c3", "    c4", "",
    ]
    assert text["https://b/"].split("\n")[1:] == ["  Exception: ConnectTimeout - slow", ""]
    files.write_by_day(events, str(tmp_path / "days"))
    assert [p.split("/")[-1] for p in glob.glob(str(tmp_path / "days" / "day=*"))] == ["day=20231114"]
    totals = {r.url: r.n for r in files.write_per_url(events, str(tmp_path / "urls")).collect()}
    assert totals == {"https://a/": 1, "https://b/": 1, None: 2}
    assert spark.read.json(str(tmp_path / "urls")).count() == 2


def test_fan_out_survives_a_broken_sink(spark, tmp_path):
    seen, failed = [], {}

    def broken(batch, batch_id):
        raise RuntimeError("no")

    run = sinks.fan_out({"broken": broken, "keep": lambda b, i: seen.append((i, b.count())), "text": sinks.text_blocks(str(tmp_path / "t"))}, failed)
    run(failures(spark), 4)
    assert seen == [(4, 2)] and failed == {"broken": 1} and glob.glob(str(tmp_path / "t" / "batch=4" / "part-*"))


def test_callbacks_run_per_event_and_errors_are_swallowed(spark, tmp_path):
    folder = str(tmp_path)

    async def note(event):
        open(f"{folder}/{event['exception_type']}", "w").close()
        raise ValueError("ignored")

    sinks.callback(note)(failures(spark), 0)
    assert {p.split("/")[-1] for p in glob.glob(f"{folder}/*")} == {"HTTPStatusError", "ConnectTimeout"}
    sinks.logger_sink(fields=["url"])(failures(spark), 0)
    shown = sinks.console_lines(failures(spark), ["url"], 2).collect()
    assert sorted(r.value for r in shown) == ["url: https://a/\n  c3\n  c4", "url: https://b/"]


def test_event_filter(spark):
    rows = [(i, s) for i, s in enumerate([None, 0, 400, 499, 500, 503])]
    df = spark.createDataFrame(rows, "id int, response_status int").withColumn("url", F.lit("u")).withColumn("exception_type", F.lit("T"))
    ids = lambda **k: [r.id for r in df.where(checks.event_filter(**k)).orderBy("id").collect()]
    assert ids(min_severity="medium") == [0, 1, 4, 5] and ids(min_severity="high") == [0, 1, 5]
    assert ids(min_severity="other") == [0, 1, 2, 3, 4, 5] and ids(types=["X"]) == [] and ids(url_patterns=["^v", "u$"]) == [0, 1, 2, 3, 4, 5]


def test_retries(spark):
    rows = [(1, i, "e" if i < 2 else None) for i in range(3)] + [(2, i, "e") for i in range(4)] + [(3, 0, None)]
    shape = "check_id long, attempt int, error_type string"
    attempts = spark.createDataFrame(rows, shape).selectExpr(
        "*", "'u' AS url", "timestamp_seconds(attempt) AS ts", "if(check_id = 3, 404, null) AS status", "'m' AS error", f"repeat('b', 1200) AS body"
    )
    out = {r.check_id: r for r in checks.collapse_retries(attempts).collect()}
    assert [(out[i].attempts, out[i].failed, out[i].backoff_seconds) for i in (1, 2, 3)] == [(3, False, 3), (4, True, 7), (1, True, 0)]
    assert len(out[2].response_body) == 1200


def test_coercion(spark):
    rows = [
        (" 12 ", "1.5", "yes", "2024-01-02T03:04:05Z", "2024", None, ("7", "raw"), [("1", ["a", "1"])]),
        ("-3", "2", "FALSE", "9999-12-31T23:59:59Z", "7", "  ", ("8", "9"), [("x", []), (None, None)]),
    ]
    shape = "i string, f string, b string, t string, y string, e string, s struct<n:string,`@odata.type`:string>, a array<struct<v:string,w:array<string>>>"
    df = spark.createDataFrame(rows, shape)
    types = coerce.infer_types(df)
    assert types == {
        "i": "bigint", "f": "double", "b": "boolean", "t": "timestamp", "y": "bigint", "e": "string", "s.n": "bigint", "a[].v": "string", "a[].w[]": "string",
    }
    out = coerce.coerce(df).collect()
    assert [r.i for r in out] == [12, -3] and [r.b for r in out] == [True, False] and out[1].t is None and out[0].t.year == 2024
    assert [r.s["@odata.type"] for r in out] == ["raw", "9"] and out[1].s.n == 8 and out[0].a[0].w == ["a", "1"]


def test_user_checks(spark):
    def breaks(path, text):
        raise KeyError("inside")

    data = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "f("), ("c.txt", "f(")], "path string, text string")
    results = validate.run_checks(data, {"syntax": validate.python_syntax, "breaks": breaks})
    out = {r.file: r for r in validate.summarize(results).collect()}
    assert (out["a.py"].total, out["a.py"].passed, out["a.py"].errors, out["a.py"].overall) == (2, 1, 1, False)
    assert (out["b.py"].passed, out["b.py"].errors) == (0, 2) and out["c.txt"].total == 1


def test_changed_line_band(spark):
    issues = spark.createDataFrame(
        [("f", m) for m in ("f.py:12:1: E1", "line 7", "(9)", "no number", "f.py:23:1")] + [("g", "line 10")], "file string, message string"
    )
    changed = spark.createDataFrame([("f", 10), ("f", 20), ("f", 11)], "file string, line int")
    kept = {(r.file, r.message) for r in validate.near_changes(issues, changed).collect()}
    assert kept == {("f", "f.py:12:1: E1"), ("f", "(9)"), ("f", "no number")}


SOURCE = '''"""Module doc."""
from abc import ABC
from dataclasses import dataclass
import numpy as np, os.path

MAX_SIZE: int = 3
name = "x"

@dataclass
class Point(ABC):
    """A point."""
    x: int = 0

    @property
    def size(self) -> float:
        """How big."""
        return np.sqrt(self.x)

    async def move(self, dx: int, *args, scale: float = 1.0, **kwargs) -> "Point":
        if dx and scale and args:
            for a in args:
                while a:
                    a -= 1
        elif dx:
            try:
                self.size()
            except ValueError:
                pass
        return self

def outer(
    a,
    b=(1, 2),
):
    def inner(y):
        return helper(y) if y else None
    match a:
        case 1:
            return inner(a)
    with open(a) as f:
        return os.path.join(f)

def __magic__(): pass
def _hidden(): pass
def __private(): pass
'''


def test_code_facts(spark):
    data = spark.createDataFrame([("p.py", SOURCE), ("bad.py", "def f(:\n"), ("empty.py", "")], "path string, text string")
    facts = code.syntax_facts(data).cache()
    funcs = {r.qualified_name: r for r in code.functions(facts).collect()}
    assert set(funcs) == {"Point.size", "Point.move", "outer", "outer.inner", "__magic__", "_hidden", "__private"}
    # if, for, while, elif, try, except, and one chain of three operands
    assert funcs["Point.move"].complexity == 1 + 6 + 2 and funcs["outer"].complexity == 1 + 3
    assert funcs["Point.size"].decorators == ["property"] and funcs["Point.size"].return_type == "float" and funcs["Point.size"].docstring == "How big."
    kinds = [(p.name, p.type, p.default, p.is_vararg, p.is_kwarg) for p in funcs["Point.move"].params]
    assert kinds == [
        ("self", None, None, False, False), ("dx", "int", None, False, False), ("args", None, None, True, False),
        ("scale", "float", "1.0", False, False), ("kwargs", None, None, False, True),
    ]
    assert funcs["outer"].signature == "outer(a, b=(1, 2))" and funcs["outer"].line_end - funcs["outer"].line_start == 10
    assert [funcs[n].visibility for n in ("__magic__", "_hidden", "__private", "outer")] == ["magic", "protected", "private", "public"]
    (point,) = code.classes(facts).collect()
    assert (point.name, point.bases, point.methods, point.is_dataclass, point.is_abstract) == ("Point", ["ABC"], ["size", "move"], True, True)
    calls = {(r.caller, r.callee) for r in code.calls(facts).collect()}
    assert {("Point.move", "Point.size"), ("outer.inner", "helper"), ("outer", "inner"), ("Point.size", "np.sqrt")} <= calls
    assert {(r.module, r.alias) for r in code.imports(facts).collect()} == {("abc", None), ("dataclasses", None), ("numpy", "np"), ("os.path", None)}
    assert {r.name: r.is_constant for r in code.variables(facts).where("class_name IS NULL").collect()} == {"MAX_SIZE": True, "name": False}
    assert {r.module for r in code.module_uses(facts).collect()} == {"np"}
    assert [r.file for r in code.errors(facts).collect()] == ["bad.py"]


def test_items_beside_their_generated_rows(spark):
    items = spark.createDataFrame([(1, "a b", [1]), (2, "", None), (3, None, []), (1, "a b", [1])], "id int, text string, tags array<int>")

    def words(item):
        for at, word in enumerate((item["text"] or "").split()):
            yield {"at": at, "word": word, "unknown": 1}

    out = records.with_generated(items, words, "at int, word string")
    assert sorted((r.id, r.at, r.word) for r in out.collect()) == [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b")]
    assert records.with_generated(items.limit(0), words, "at int, word string").count() == 0
    with pytest.raises(ValueError):
        records.with_generated(items, words, "id int")
