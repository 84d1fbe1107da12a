"""Traces that cross chunks and micro-batches, the trace-aware prefixed detector, numbered files, named groups."""

import random
import re

import pytest
from pyspark.sql import functions as F

from traceframe.operators import logs, ordered
from traceframe.sinks import streaming as sinks
from traceframe.sources import text_lines
from traceframe.streaming import live
from traceframe.streaming.carry import Carry

TB = "Traceback (most recent call last):"
SHAPE = "stream_id string, line_no long, line string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("line_no")))


def test_a_trace_longer_than_its_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 8)
    body = [f"    frame {i}" for i in range(50)]
    rows = [("s", i, t) for i, t in enumerate(["INFO up", TB, *body, "ValueError: end", "INFO down", TB, "KeyError: x", TB, "open"])]
    marked = logs.trace_lines(logs.detect_lines(frame(spark, rows).repartition(4)))
    got = sorted(map(tuple, logs.trace_rows(marked).collect()))
    assert got == [("s", 1, 52, i, t.strip()) for i, t in enumerate([TB, *body, "ValueError: end"], 1)] + [("s", 54, 55, 54, TB), ("s", 54, 55, 55, "KeyError: x")]
    plain = {(r.line_no, r.exception_type): r for r in logs.build_events(marked, reach=None).collect()}
    assert plain[52, "ValueError"].trace_start == 1 and "stacktrace" not in plain[52, "ValueError"].asDict() and plain[56, "PythonTraceback"].trace_start is None
    near = {(r.line_no, r.exception_type): r.stacktrace for r in logs.build_events(marked, reach=10).collect()}
    assert near[52, "ValueError"] == [TB, *(b.strip() for b in body[:9])] and near[55, "KeyError"] == [TB, "KeyError: x"]
    assert set(near) == set(plain)


def test_events_gather_nothing_unless_asked(spark):
    lines = frame(spark, [("s", 1, TB)])
    text = logs.exception_events(lines, reach=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text and "collect_list" in logs.exception_events(lines)._jdf.queryExecution().optimizedPlan().toString()


class Plain:
    """The prefixed detector line by line."""

    def __init__(self):
        self.inside, self.app, self.start = False, (None, None, None), None

    def see(self, no, line):
        if not any(t in line for t in logs.PYTHON_INDICATORS):
            return None
        prefix = re.search(r"(\w+)<(\d+)>\((\d+)\)\s+(.*)", line)
        if TB[:-1] in line:
            self.inside, self.start = True, no
            if prefix and prefix[4].startswith("Traceback"):
                self.app = prefix.groups()[:3]
            return ("traceback_start", None, None, None, *self.app, no)
        file = re.search(r'\w+<\d+>\(\d+\)\s+File\s+"(.*?\.py)",\s+line\s+(\d+)', line, re.I)
        if self.inside and file:
            return ("python_file", None, file[1], int(file[2]), *self.app, self.start)
        for name, types in logs.PREFIXED_TYPES:
            hit = re.search(rf"(\w+)<(\d+)>\((\d+)\)\s+({types}):", line, re.I)
            if hit:
                out = ("python_exception", name, None, None, *(self.app if self.inside else hit.groups()[:3]), self.start if self.inside else None)
                if self.inside:
                    self.inside, self.app, self.start = False, (None, None, None), None
                return out
        return None


@pytest.mark.parametrize("seed,chunk", [(1, 4), (2, 7), (3, 1 << 16)])
def test_prefixed_events_equal_a_line_by_line_reading(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", chunk)
    random.seed(seed)
    pool = [TB, "app<1>(2) " + TB, "web<33>(4) " + TB, 'app<1>(2) File "/a/b.py", line 7, in f', '  File "/a/b.py", line 8', "app<1>(2) ValueError: no", "ValueError: bare", "INFO nothing",
            'web<3>(9) KeyError: in File "x.py", line 3', 'web<3>(9) File "x.py", line 3 and web<3>(9) KeyError: both', "db<5>(6) Exception: general", "app<9>(9) memoryerror: Error: low"]
    rows = [(s, i * 2, random.choice(pool)) for s in ("s", "t") for i in range(150)]
    want = []
    for s in ("s", "t"):
        reader = Plain()
        want += [(s, no, *out) for key, no, line in rows if key == s and (out := reader.see(no, line))]
    got = logs.prefixed_events(frame(spark, rows).repartition(3)).select("stream_id", "line_no", "type", "pattern", "filename", "line_number", *logs.APP_FIELDS, "trace_start")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert logs.prefixed_events(frame(spark, rows).limit(0)).count() == 0


def test_what_is_carried_does_not_grow_with_an_open_trace(spark, tmp_path):
    rows = [("s", i, TB if i == 0 else "ValueError: at last" if i == 399 else f"frame {i}") for i in range(400)]
    sizes = []
    for trace_sink, reach in ((sinks.folder(str(tmp_path / "traces")), 1000), (None, 20)):
        root = str(tmp_path / ("rows" if trace_sink else "lines"))
        run = live.live_exceptions(sinks.folder(f"{root}/out"), Carry(f"{root}/carry", keep=9), context=5, reach=reach, trace_sink=trace_sink)
        for batch in range(4):
            run(frame(spark, rows[batch * 100 : batch * 100 + 100]), batch)
        sizes.append([spark.read.parquet(f"{root}/carry/version={b}").count() for b in range(3)])
        event = spark.read.parquet(f"{root}/out").where("exception_type = 'ValueError'").collect()
        assert [(r.line_no, r.trace_start, r.line_number, r.total_exceptions_found) for r in event] == [(399, 0, 400, 2)]
        if not trace_sink:
            assert event[0].stacktrace == [TB, *(f"frame {i}" for i in range(1, 20))]
    assert sizes == [[5, 5, 5], [24, 24, 24]]
    lines = spark.read.parquet(str(tmp_path / "traces")).orderBy("line_no").collect()
    assert [(r.trace_start, r.line_no, r.text) for r in lines] == [(0, i, t) for _, i, t in rows]


def test_files_are_numbered_dated_and_named(spark, tmp_path):
    folder = tmp_path / "in"
    for name in ("stream=a", "b"):
        (folder / name).mkdir(parents=True)
    (folder / "stream=a" / "2.log").write_text("third\n\n2024-05-06 07:08:09,5 fourth\n")
    (folder / "stream=a" / "1.log").write_text("2024-05-06T07:08:09.123456 first\n2024-99-99 00:00:00 second\n")
    (folder / "b" / "x.log").write_text("\n \nonly\n")
    seen = []
    stream = text_lines.stream_lines(spark, str(folder / "*"))
    live.run_bounded(live.start(stream, lambda batch, i: seen.extend(text_lines.place_lines(batch).collect()), str(tmp_path / "check"), available_now=True))
    got = sorted((r.stream_id, r.line_no, r.line, str(r.ts) if r.ts.year == 2024 and r.ts.month == 5 else None) for r in seen)
    assert [g[:3] for g in got] == [("a", 1, "first"), ("a", 2, "2024-99-99 00:00:00 second"), ("a", 3, "third"), ("a", 4, "fourth"), ("b", 1, "only")]
    assert [g[3] is not None for g in got] == [True, False, False, True, False] and all(r.file_ts is not None and r.block == 0 for r in seen)


def test_user_patterns_with_severity_and_references(spark):
    twice = logs.LinePattern.named("twice", r"(?P<exception_type>\w+)-(?P=exception_type)1 (?P<severity>warn|fatal)[(?P<x>]*[]\[]? (?P<message>.*)")
    lines = spark.createDataFrame([("ab-ab1 warn go",), ("ab-cd1 warn go",), ("Zz-zz1 FATAL(] stop",)], "line string")
    hits = [r.h for r in lines.select(logs.first_match(F.col("line"), [twice]).alias("h")).collect()]
    assert [(h.exception_type, h.severity, h.message) if h else None for h in hits] == [("ab", "WARN", "go"), None, ("Zz", "FATAL", "stop")]
    events = logs.exception_events(frame(spark, [("s", 1, "ab-ab1 warn go")]), [logs.LinePattern.named("python_twice", twice.regex[4:]), ], reach=None)
    assert events.count() == 1
    events = logs.exception_events(frame(spark, [("s", 1, "boom fatal: x")]), [logs.LinePattern.named("python_boom", r"boom (?P<severity>\w+): (?P<message>.*)")], reach=None)
    assert [(r.severity, r.message) for r in events.collect()] == [("FATAL", "x")]
