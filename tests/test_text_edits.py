"""Globs, grep, markdown, HTML, edits, diffs, graph, URLs."""

import pytest
from pyspark.sql import functions as F

from traceframe.functions import globs, html, text
from traceframe.operators import code, edits, graph, mail, search
from traceframe.operators.markdown import table_cells

PATHS = [
    ".venv/lib/python3/site-packages/pkg/_core.py", ".git/config", "src/main.py", "tests/test_main.py", "project/tests/unit/test_auth.py",
    "build/lib/package.py", "docs/readme.md", "__pycache__/main.cpython.pyc", "node_modules/express/lib/express.js", "examples/simple.py", "scripts/deploy.py",
]
# glob -> positions of the paths it excludes
MATRIX = {
    ".venv": [0], ".git": [1], "test*": [3, 4], "*test*": [3, 4], "__pycache__": [7], "build": [5], "*/build/*": [], "build/*": [5], ".*": [0, 1],
    "*.pyc": [7], "node_modules": [8], "lib": [0, 5, 8], "src/main.py": [2], "project/tests": [4], "unit/*": [4], "e?amples": [9], "[!.]*.md": [6],
}


@pytest.mark.parametrize("glob", list(MATRIX))
def test_exclusion(spark, glob):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PATHS)], "i int, path string")
    assert [r.i for r in df.where(globs.excluded(F.col("path"), [glob])).orderBy("i").collect()] == MATRIX[glob]


def test_presets(spark):
    assert globs.exclusion_preset("unknown") == () and len(globs.exclusion_preset("comprehensive")) == 33
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    kept = [r.path for r in df.where(~globs.excluded(F.col("path"), globs.exclusion_preset("comprehensive"))).collect()]
    assert kept == ["src/main.py"]
    assert df.where(globs.excluded(F.col("path"), [])).count() == 0


def test_grep(spark):
    files = spark.createDataFrame(
        [("a.py", "log.info('x')\n  LOG it \n"), ("b/empty.py", ""), ("b/nämé.py", "def hello(): # hello\r\nlog"), ("c.txt", "log")], "path string, text string"
    )
    hits = search.grep(files, "log").orderBy("path", "line_no").collect()
    assert [(r.path, r.line_no, r.highlighted) for r in hits] == [("a.py", 1, "[log].info('x')"), ("a.py", 2, "[LOG] it"), ("b/nämé.py", 2, "[log]")]
    assert search.grep(files, "Hello", case_sensitive=True).count() == 0
    assert search.grep(files, "def.*:").first().highlighted == "[def hello():] # hello"
    assert [r.path for r in search.grep(files, "log", "*", limit=2).collect()] == ["a.py", "a.py"]


def test_function_lookup_suggests_only_without_a_match(spark):
    names = spark.createDataFrame([("Load",), ("Reload",), ("preload_all",)], "full_name string")
    got = lambda n: [(r.full_name, r["rank"]) for r in search.lookup_function(names, n).orderBy("rank", "full_name").collect()]
    assert got("Load") == [("Load", 0)] and got("load") == [("Reload", 1), ("preload_all", 1)]
    assert got("PRELOAD") == [("preload_all", 2)] and got("none") == []


def test_containing_function_is_the_innermost(spark):
    funcs = spark.createDataFrame([("f", "outer", 1, 300), ("f", "inner", 100, 120), ("g", "other", 1, 9)], "file string, name string, line_start int, line_end int")
    places = spark.createDataFrame([(1, "f", 110), (2, "f", 130), (3, "f", 301), (4, "h", 1)], "id int, file string, line int")
    found = search.containing_function(places, funcs, ["id"])
    assert {r.id: r.function for r in found.collect()} == {1: "inner", 2: "outer", 3: None, 4: None}
    shown = {r.id: (r["first"], r["last"]) for r in search.preview_range(found).collect()}
    assert shown == {1: (98, 122), 2: (1, 302), 3: (291, 311), 4: (1, 11)}


def test_partial_paths(spark):
    files = spark.createDataFrame([("a.py",), ("x/a.py",), ("x/b.py",)], "path string")
    found = lambda **k: {r.request: r.file for r in search.unique_paths(files, ["a.py", "b", "x/", "none"], **k).collect()}
    assert found() == {"a.py": "a.py", "b": "x/b.py"} and found(exact_first=False) == {"b": "x/b.py"}


def test_preview_marks_the_line(spark):
    files = spark.createDataFrame([("a", "\n".join(f"l{i}" for i in range(1, 8)))], "path string, text string")
    asked = spark.createDataFrame([("a", 5, 99, 6)], "path string, first int, last int, line int")
    assert [r.shown for r in search.preview(asked, files, "line").orderBy("line_no").collect()] == ["   5 | l5", "   6 >>> l6", "   7 | l7"]


MD = "| A | B |\n|---|---|\n| 1 | :white_check_mark: |\n| 2 |\n\nafter | no table |\n# H\n- item\n**b**\n```py\nx\n```"


def test_markdown(spark):
    df = spark.createDataFrame([(1, MD), (2, "no table")], "id int, md string")
    cells = [(r.row_no, r.header, r.value) for r in table_cells(df, "id", "md").orderBy("row_no", "column_no").collect()]
    assert cells == [(1, "A", "1"), (1, "B", ":white_check_mark:"), (2, "A", "2")]
    out = {r.id: r.t for r in df.select("id", text.markdown_to_chat(F.col("md")).alias("t")).collect()}
    assert out[1] == "  *A*: 1\n  *B*: ✅\n\n  *A*: 2\n\nafter | no table |\n*H*\n• item\n*b*\n```\nx\n```" and out[2] == "no table"


def test_html(spark):
    td = "<table><thead><tr><td>ID</td><td>Name</td></tr></thead><tbody><tr class='technique'><td>A1</td><td> one &amp; two </td></tr><tr class='sub technique'><td></td><td>.001</td><td>sub</td></tr></tbody></table>"
    th = "<p>x</p><table><tr><th>ID</th><th>Name</th></tr><tr><td>B2</td><td>b</td></tr></table><table><tr><td>second</td></tr></table>"
    pages = spark.createDataFrame([("p", td), ("q", th), ("r", "none")], "id string, html string")
    rows = html.table_rows(pages, "id")
    named = [(r.Name, r.ID) for r in html.named_cells(rows, ["ID", "Name"]).orderBy("id", "row_no").collect()]
    assert named[0] == ("one & two", "A1") and named[2] == ("b", "B2")
    assert html.plain_text("a<![odd[x]]>b <p>c") is not None and html.plain_text(None) is None
    assert html.plain_text("<h1>A&amp;B</h1><script>var t='</p>';</script><p>c <b>d</b>\n e<br>f") == "A&B\nc d\ne\nf"


def test_technique_ids(spark):
    rows = [("p", 1, "technique", ["ID", "Name"], ["A1", "one"]), ("p", 2, "sub technique", ["ID", "Name"], ["", ".001", "x"]), ("p", 3, "sub technique", ["ID", "Name"], ["", ".002", "y"])]
    df = spark.createDataFrame(rows, "page string, row_no int, row_class string, header array<string>, cells array<string>")
    out = html.technique_rows(df, "page", "u/").orderBy("row_no").collect()
    assert [(r.id, r.name, r.hyperlink) for r in out] == [("A1", "one", "u/A1"), ("A1.001", "x", "u/A1/001"), ("A1.002", "y", "u/A1/002")]


def test_line_edits(spark):
    files = spark.createDataFrame([("f", "a = 1\n  b = 2\nc"), ("g", "same")], "file string, text string")
    plan = [
        ("f", 1, 1, "a = 1", "a = 9"), ("f", 1, 2, "a = 9", "a = 10"), ("f", 2, 3, " b = 2 ", "b = 3"), ("f", 3, 4, "stale", "x"),
        ("f", 9, 5, "y", "z"), ("none", 1, 6, "y", "z"), ("f", 3, 7, " ", "z"),
    ]
    rows = spark.createDataFrame(plan, "file string, line int, seq int, old_content string, new_content string")
    (out,) = edits.apply_line_edits(files, rows).collect()
    assert (out.file, out.text, out.applied) == ("f", "a = 10\n  b = 3\nc", 3)
    status = {r.seq: r.status for r in edits.line_edit_status(files, rows).collect()}
    assert status == {1: "applied", 2: "applied", 3: "applied", 4: "mismatch", 5: "out_of_range", 6: "no_file", 7: "empty"}


def test_line_edits_of_long_files_and_odd_rows(spark):
    n = 20_000
    body = "\n".join(f"v{i} = {i}" for i in range(1, n + 1))
    files = spark.createDataFrame([("long", body), ("void", None), ("blank", ""), ("twice", "a\nb"), ("twice", "b\nb"), ("other", "z")], "file string, text string")
    plan = [("long", i, 1, f"v{i} = {i}", f"w{i}") for i in range(1, n + 1, 3)] + [
        ("void", 1, 1, "a", "b"), ("blank", 1, 1, "x", "y"), ("twice", 1, 1, "a", "c"), ("long", None, 2, "x", "y"), ("long", 0, 3, "x", "y"),
        ("long", n + 1, 4, "x", "y"), (None, 1, 5, "x", "y"), ("long", 2, 6, None, "y"),
    ]
    rows = spark.createDataFrame(plan, "file string, line int, seq int, old_content string, new_content string")
    out = sorted(((r.file, r.text, r.applied) for r in edits.apply_line_edits(files, rows).collect()), key=str)
    want = "\n".join(f"w{i}" if i % 3 == 1 else f"v{i} = {i}" for i in range(1, n + 1))
    # an empty line is held by any old text, and holds nothing to replace
    assert out == sorted([("long", want, len(range(1, n + 1, 3))), ("void", None, 0), ("blank", "", 1), ("twice", "c\nb", 1), ("twice", "b\nb", 0)], key=str)
    status = edits.line_edit_status(files, rows).where("file is null or file <> 'long' or seq > 1").collect()
    assert sorted(((r.file, r.line, r.seq, r.status) for r in status), key=str) == sorted([
        ("void", 1, 1, "out_of_range"), ("blank", 1, 1, "applied"), ("twice", 1, 1, "applied"), ("twice", 1, 1, "mismatch"), (None, 1, 5, "no_file"),
        ("long", None, 2, "out_of_range"), ("long", 0, 3, "out_of_range"), ("long", n + 1, 4, "out_of_range"), ("long", 2, 6, "mismatch"),
    ], key=str)
    assert edits.apply_line_edits(files, rows.limit(0)).count() == 0 and edits.apply_line_edits(files.limit(0), rows).count() == 0


def test_texts_of_files_without_edits_are_not_shuffled(spark, tmp_path):
    spark.range(300).selectExpr("concat('f', id) as file", "concat('line one of ', id, '\n', repeat('x', 2000)) as text").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    rows = spark.createDataFrame([("f7", 1, 1, "one", "two")], "file string, line int, seq int, old_content string, new_content string")
    out = edits.apply_line_edits(files, rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the class list is looked up on the scan's side of every exchange that carries texts, and no line becomes a row
    assert "Generate" not in plan and "LeftSemi, BuildRight" in plan
    (row,) = out.collect()
    assert row.file == "f7" and row.text.startswith("line two of 7\n") and row.applied == 1
    replaced = edits.replace_first(files, spark.createDataFrame([("f7", "one", "two"), ("gone", "one", "two")], "file string, search string, replacement string"))
    assert "LeftSemi, BuildRight" in replaced._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.file, r.status) for r in replaced.collect()) == [("f7", "replaced"), ("gone", "no_file")]


def test_replace(spark):
    body = "x = 1\nprint(x)\nx  =  1\nprint(x)"
    files = spark.createDataFrame([("f", body)], "file string, text string")
    edit = lambda s, r, a=None, b=None: spark.createDataFrame([("f", s, r, a, b)], "file string, search string, replacement string, start_line int, end_line int")
    first = edits.replace_first(files, edit("print(x)", "p")).first()
    assert (first.status, first.line, first.text) == ("multiple", 2, "x = 1\np\nx  =  1\nprint(x)")
    assert edits.replace_first(files, edit("nope", "p")).first().status == "not_found"
    every = edits.replace_all(files, edit("print(x)", "p$1")).first()
    assert (every.replaced, every.text) == (2, "x = 1\np$1\nx  =  1\np$1")
    ranged = edits.replace_in_range(files, edit("x = 1", "y.[1]", 3, 3)).first()
    assert (ranged.status, ranged.text) == ("replaced", "x = 1\nprint(x)\ny.[1]\nprint(x)")
    assert edits.replace_in_range(files, edit("print(x)", "p", 3, None)).first().text.endswith("x  =  1\np")
    assert edits.replace_in_range(files, edit("print(x)", "p", 3, 3)).first().status == "not_found"


DIFF = """diff --git a/m.py b/m.py
index 1..2
--- a/m.py
+++ b/m.py
@@ -1,2 +1,2 @@
 ctx
-x = 1
+x = 2
@@ -9 +9 @@
-gone
--- /dev/null
+++ b/new.py
@@ -0,0 +1 @@
+hello
"""


def test_diffs(spark):
    df = spark.createDataFrame([(1, DIFF), (2, "-f(1)\n ctx\n+g(2)"), (3, DIFF.replace("\n", "\r\n"))], "diff_id int, text string")
    rows = edits.diff_counts(df).where("diff_id = 1").orderBy("file_no", "hunk_no").collect()
    assert [(r.target, r.hunk_no, r.added, r.removed) for r in rows] == [("m.py", 1, 1, 1), ("m.py", 2, 0, 1), ("new.py", 1, 1, 0)]
    assert edits.diff_counts(df).where("diff_id = 3").count() == 3
    assert sorted(r.file for r in edits.diff_files(df).where("diff_id = 1").collect()) == ["m.py", "new.py"]
    pairs = sorted((r.kind, r.old, r.new) for r in edits.diff_replacements(df).where("diff_id = 1").collect())
    assert ("line", "x = 1", "x = 2") in pairs and ("value", "1", "2") in pairs
    assert [(r.kind, r.old, r.new) for r in edits.diff_replacements(df).where("diff_id = 2").collect()] == [("call", "f(1)", "g(2)")]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("e", "d")], "caller string, callee string")
    start = spark.createDataFrame([("a",)], "name string")
    depth = lambda d: {r.node: r.depth for r in graph.call_chain(e, start, d).collect()}
    assert depth(0) == {"a": 0} and depth(1) == {"a": 0, "b": 1, "d": 1} and depth(5) == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert {r.name: (r.calls, r.called_by) for r in graph.degrees(e).collect()}["a"] == (2, 1)
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert {r.callee for r in graph.resolve_callees(e, known).where("NOT resolved").collect()} == {"d"}
    assert {(r.caller, r.callee) for r in graph.induced_edges(e, graph.top_by_degree(e, 2)).collect()} == {("a", "b")}


def test_hotspots(spark):
    rows = [("A", "error")] + [("B", "warning")] * 4 + [("C", "warning")] * 3 + [("D", "error")] * 2
    diag = spark.createDataFrame(rows, "file string, severity string")
    top = spark.createDataFrame([("D", 7), ("C", 50)], "file string, complexity int")
    assert [(r.file, r.score) for r in code.hotspots(diag, top).collect()] == [("D", 27), ("A", 10), ("B", 8)]


def test_repository_urls(spark):
    urls = ["own/rep", "https://github.com/o/r.git", "https://GitLab.com/o/r/tree", "https://bitbucket.org/o/r", "https://git.e.org/P1", "https://tok@git.e.org/a/b/c.git", "https://github.com/o", "./x", "git@h:o/r"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", text.repository_fields(F.col("url")).alias("r"))
    out = {r.url: r.r for r in df.collect()}
    assert out["own/rep"].archive_url == "https://github.com/own/rep/archive/refs/heads/main.zip"
    assert (out[urls[1]].platform, out[urls[1]].repo) == ("github", "r") and out[urls[2]].archive_url == "https://gitlab.com/o/r/-/archive/main/r-main.zip"
    assert out[urls[3]].branch == "master" and (out[urls[4]].owner, out[urls[4]].repo) == ("unknown", "P1")
    assert (out[urls[5]].owner, out[urls[5]].repo, out[urls[5]].auth) == ("a/b", "c", "token")
    assert out[urls[6]].repo is None and out[urls[7]].repo is None and out[urls[8]].auth == "ssh"


def test_mail(spark):
    who = lambda a: {"emailAddress": {"name": a, "address": a}} if a else None
    rows = [
        ("1", "c1", who("a@e"), [who("b@e")], "2024-01-01 10:00:00"), ("2", "c1", who("b@e"), [who("a@e")], "2024-01-02 23:59:59.5"),
        ("3", "c2", None, [who("a@e")], "2024-01-03 00:00:00"), ("4", "c3", who("a@e"), [who("a@e")], "2024-01-01 00:00:00"),
    ]
    a = "struct<emailAddress:struct<name:string,address:string>>"
    df = spark.createDataFrame(rows, f"id string, conversationId string, `from` {a}, toRecipients array<{a}>, at string")
    df = df.withColumn("receivedDateTime", F.to_timestamp("at")).withColumn("ccRecipients", F.lit(None).cast(f"array<{a}>")).withColumn("bccRecipients", F.lit(None).cast(f"array<{a}>"))
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(mail.newest_per_conversation(df)) == ["2", "3", "4"] and ids(df.where(mail.has_sender())) == ["1", "2", "4"]
    assert ids(mail.involving(df, "A@E")) == ["1", "2", "3", "4"]
    assert ids(df.where(mail.between_days(F.col("receivedDateTime"), "2024-01-01", "2024-01-02"))) == ["1", "2", "4"]
    assert ids(df.where(mail.search({"recipients": "b@"}))) == ["1", "2"] and ids(df.where(mail.search({"from": "x=y"}))) == []
    assert [r.id for r in mail.newest_first(df, 2).collect()] == ["3", "2"]
    body = df.limit(1).withColumn("body", F.expr("named_struct('contentType', 'html', 'content', '<p>hi</p>')"))
    assert mail.with_body_text(body).first().bodyText == "hi"
