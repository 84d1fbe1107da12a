"""Classes by scope, function ends in one pass, edits that say what they did."""

import random
import re
import time

from pyspark.sql import functions as F

from traceframe.operators import code, edits, search

SOURCE = '''
class A:
    def f(self): pass

try:
    class A(Base):
        @property
        def g(self): return 1
        @g.setter
        def g(self, v): pass
except ImportError:
    class A:
        @staticmethod
        def h(): pass

class O:
    class A:
        @classmethod
        def h(cls):
            return self.other()
        class B:
            x = 1
    def own(self):
        class Local:
            def inner(self): pass
        return 1

def top():
    class A:
        def k(self): pass
'''


def test_classes_of_one_name_keep_their_own_methods(spark):
    files = spark.createDataFrame([("m.py", SOURCE), ("e.py", ""), ("n.py", "class A:\n    def z(self): pass\n")], "path string, text string")
    facts = code.syntax_facts(files).cache()
    found = sorted((r.file, r.line_start, r.name, tuple(r.methods), tuple(r.bases)) for r in code.classes(facts).collect())
    assert [x[2:] for x in found if x[0] == "m.py"] == [
        ("A", ("f",), ()), ("A", ("g", "g"), ("Base",)), ("A", ("h",), ()), ("O", ("own",), ()), ("O.A", ("h",), ()),
        ("O.A.B", (), ()), ("Local", ("inner",), ()), ("A", ("k",), ()),
    ]
    assert code.corpus_totals(files, facts).first().classes == len(found) == 9
    named = {(r.qualified_name, r.line_start): r for r in code.functions(facts).where("file = 'm.py'").collect()}
    flags = {k[0]: (r.is_property, r.is_classmethod, r.is_staticmethod) for k, r in named.items()}
    assert flags["O.A.h"] == (False, True, False) and flags["A.h"] == (False, False, True) and flags["A.g"] == (True, False, False) and flags["O.own"] == (False,) * 3
    assert len([k for k in named if k[0] == "A.g"]) == 2


def plain_ends(text):
    lines = re.sub("\n$", "", text).split("\n")
    indent = lambda x: len(x) - len(x.lstrip(" \t"))
    out = []
    for p, line in enumerate(lines):
        if not re.match(r"\s*(async\s+)?def\s+\w+", line):
            continue
        body = [(i, x.rstrip()) for i, x in enumerate(lines) if i > p and x.strip()]
        first = next(((i, x) for i, x in body if not x.endswith(":")), None)
        stop = next((i for i, x in body if first and i >= first[0] and i > p + 2 and indent(x) <= indent(first[1]) and x.strip()[0] not in "#@"), None)
        out.append((re.search(r"def\s+(\w+)", line)[1], p + 1, stop if stop is not None else len(lines)))
    return out


def test_function_ends_equal_a_plain_reading(spark):
    random.seed(3)
    pool = ["def a():", "    def b(x):", "        return 1", "    y = 2", "", "   ", "# note", "    @deco", "if x:", "z = 3", "async def c(", "        ):", "            deep()", "    # in", "\tdef t():", "\t\tpass"]
    texts = [(str(k), "\n".join(random.choice(pool) for _ in range(random.randrange(0, 40)))) for k in range(150)] + [("none", None), ("empty", ""), ("one", "def a():")]
    got = sorted((r.path, r.name, r.line_start, r.line_end) for r in search.function_ends(spark.createDataFrame(texts, "path string, text string")).collect())
    assert got == sorted((k, *x) for k, t in texts if t is not None for x in plain_ends(t))


def test_function_ends_of_a_long_file(spark):
    text = "\n".join(f"def f{i}(a):\n    x = {i}\n    if x:\n        y = 1\n\n    # note\n        z = 2\n        w = 3\n\n" for i in range(2200))
    start = time.time()
    rows = search.function_ends(spark.createDataFrame([("long.py", text)], "path string, text string")).collect()
    assert len(rows) == 2200 and text.count("\n") > 19_000 and time.time() - start < 30
    assert sorted((r.name, r.line_start, r.line_end) for r in rows)[:50] == sorted(plain_ends(text))[:50]


def test_edits_say_what_they_did(spark):
    cases = [("foo\nbar", "foo bar"), ("foo  bar", "foo bar"), ("foo   ", "x foo"), ("foo\tbar", "foo \n bar"), ("a.b", "axb"), ("  ", "a  b"), ("", "abc"), ("foo bar", "foo   bar foo bar")]
    files = spark.createDataFrame([(str(i), t) for i, (_, t) in enumerate(cases)], "file string, text string")
    asked = spark.createDataFrame([(str(i), s, "Z") for i, (s, _) in enumerate(cases)], "file string, search string, replacement string")
    whole = asked.withColumns({"start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int")})
    got = {int(r.file): (r.text, r.status) for r in edits.replace_in_range(files, whole).collect()}
    assert got == {
        0: ("Z", "replaced"), 1: ("Z", "replaced"), 2: ("x Z", "replaced"), 3: ("Z", "replaced"), 4: ("axb", "not_found"), 5: ("a  b", "empty"),
        6: ("abc", "empty"), 7: ("foo   bar Z", "replaced"),
    }
    first = {int(r.file): (r.text, r.status) for r in edits.replace_first(files, asked).collect()}
    assert first[6] == ("abc", "empty") and first[7] == ("foo   bar Z", "replaced") and first[4] == ("axb", "not_found")
