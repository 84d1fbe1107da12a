"""Chunked scans must give what a plain window per key gives, whatever the chunk size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from traceframe.operators import alerts, logs, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [
        ("a" if rng.random() < 0.6 else rng.choice(["b", "c", None]), i, rng.choice([None, 1, 2, 3]), 1_700_000_000 + rng.randint(0, 400) * 7)
        for i in range(500)
    ]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, n long, v int, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(7)


def same(got, want):
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_scan_equals_window(rows, size):
    chunked = rows.withColumn("c", ordered.number_chunk(F.col("n"), size))
    got = ordered.ordered_scan(
        chunked, ["k"], "c", ["n"], sums={"total": F.coalesce("v", F.lit(0))}, last={"prev": F.col("v")}, next={"later": F.col("v")}
    ).select("k", "n", "total", "prev", "later")
    w = Window.partitionBy("k").orderBy("n")
    want = rows.select(
        "k",
        "n",
        F.sum(F.coalesce("v", F.lit(0))).over(w).alias("total"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"),
        F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    same(got, want)


@pytest.mark.parametrize("limit", [0, 5, 10_000])
def test_numbers_with_crowded_intervals(rows, limit):
    chunked = ordered.time_chunks(rows, ["k"], "ts", coarse_seconds=1000, fine_seconds=10, limit=limit)
    got = ordered.number_rows(chunked, ["k"], "__chunk", ["ts", "n"], "no").select("k", "n", "no")
    want = rows.select("k", "n", F.row_number().over(Window.partitionBy("k").orderBy("ts", "n")).cast("long").alias("no"))
    same(got, want)


@pytest.mark.parametrize("size", [3, 10, 1000])
def test_last_rows(rows, size):
    w = Window.partitionBy("k").orderBy("n")
    dense = rows.withColumn("no", F.row_number().over(w))
    got = ordered.last_rows(dense, ["k"], "no", F.col("n"), 4, "tail", size).select("k", "n", "tail")
    want = rows.select("k", "n", F.collect_list("n").over(w.rowsBetween(-3, 0)).alias("tail"))
    same(got, want)


def test_last_rows_shorter_chunk_than_tail(rows):
    dense = rows.withColumn("no", F.row_number().over(Window.partitionBy("k").orderBy("n")))
    with pytest.raises(ValueError):
        ordered.last_rows(dense, ["k"], "no", F.col("n"), 10, "tail", 4)


@pytest.mark.parametrize("seconds,chunk,limit", [(70, 30, 10_000), (300, 3600, 10_000), (1, 5, 10_000), (300, 3600, 3)])
def test_trailing_counts(rows, seconds, chunk, limit):
    got = ordered.trailing_counts(rows, ["k"], "ts", seconds, "n_recent", chunk, 1, limit).select("k", "n", "n_recent")
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    same(got, rows.select("k", "n", F.count(F.lit(1)).over(w).alias("n_recent")))


def test_rows_without_a_time_are_kept(spark):
    rows = spark.createDataFrame([("u", None, 1), ("u", 5, 2), (None, None, 3)], "k string, s long, id int").withColumn("ts", F.timestamp_seconds("s"))
    numbered = alerts.numbered(rows, ["k"], "ts", "id").select("id", "n_event").collect()
    assert sorted(map(tuple, numbered)) == [(1, 1), (2, 2), (3, 1)]
    counted = ordered.trailing_counts(rows, ["k"], "ts", 10, "n").select("id", "n").collect()
    assert sorted(map(tuple, counted)) == [(1, None), (2, 1), (3, None)]


def test_trailing_alert_edges(spark):
    base = 1_700_000_000
    rows = [("u", base + s, i) for i, s in enumerate([0, 100, 299, 300, 600])]
    events = spark.createDataFrame(rows, "url string, s long, id int").withColumn("ts", F.timestamp_seconds("s"))
    found = alerts.trailing_alerts(events, ["url"], "ts", 300, 3).select("id", "n_recent").collect()
    # the event exactly 300 s old is outside: at 300 the window holds 100, 299 and 300
    assert sorted(map(tuple, found)) == [(2, 3), (3, 3)]


def test_equal_times_are_peers_and_reset_fires_every_third(spark):
    rows = [("u", 10, i) for i in range(7)]
    events = spark.createDataFrame(rows, "url string, s long, id int").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.n_recent for r in alerts.trailing_alerts(events, ["url"], "ts", 5, 1).collect()} == {7}
    fired = alerts.count_reset_alerts(events, ["url"], "ts", "id", 3).select("id").collect()
    assert sorted(r.id for r in fired) == [2, 5]


LOG = """app1<7>(11) Traceback (most recent call last):
app1<7>(11)   File "/x/a.py", line 3, in f
    call()
app1<7>(11) CustomError: inner
CustomError: not detected without prefix
JSONDecodeError: nor this
ValueError: alone
Traceback (most recent call last):
  dropped
app2<8>(12) Traceback (most recent call last):
  File "/y/b.py", line 1
MemoryError: full
INFO fine
RecursionError: deep
valueerror: lower case
Traceback (most recent call last):
  never closed""".split("\n")


def log_lines(spark):
    rows = [("s", i, line) for i, line in enumerate(LOG)] + [("t", i, line) for i, line in enumerate(LOG[6:13])]
    return spark.createDataFrame(rows, "stream_id string, line_no long, line string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("line_no")))


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_tracebacks(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", size)
    found = logs.exception_events(log_lines(spark).repartition(5)).where("stream_id = 's'").orderBy("line_no").collect()
    short = [(r.line_no, r.exception_type, r.severity, len(r.stacktrace)) for r in found]
    assert short == [
        (0, "PythonTraceback", "ERROR", 1),
        (3, "CustomError", "ERROR", 4),
        (6, "ValueError", "ERROR", 0),
        (7, "PythonTraceback", "ERROR", 1),
        (9, "PythonTraceback", "ERROR", 1),
        (11, "MemoryError", "ERROR", 3),
        (13, "RecursionError", "CRITICAL", 0),
        (14, "valueerror", "ERROR", 0),
        (15, "PythonTraceback", "ERROR", 1),
    ]
    by_line = {r.line_no: r for r in found}
    assert by_line[3].stacktrace[0] == LOG[0] and by_line[3].stacktrace[-1] == LOG[3]
    assert by_line[3].app.app_name == "app1" and by_line[11].app.app_name == "app2"
    # the trace above does not lend its app to a later line
    assert by_line[13].app.app_name is None
    assert by_line[14].total_exceptions_found == 8


def test_context_ring(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 2)
    rows = [("s", i * 10, f" line{i} ") for i in range(1, 8)] + [("s", 5, "   ")]
    lines = spark.createDataFrame(rows, "stream_id string, line_no long, line string").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    numbered = logs.number_lines(lines)
    events = numbered.where(F.col("line_no").isin(1, 2, 7)).select("stream_id", "line_no")
    got = {r.line_no: r.context_lines for r in logs.with_context(events, numbered, 3).collect()}
    ends = lambda xs: [x.split("Line ")[1] for x in xs]
    assert ends(got[1]) == ["1: line1"] and ends(got[2]) == ["1: line1", "2: line2"]
    assert ends(got[7]) == ["5: line5", "6: line6", "7: line7"]


def test_prefixed_detector_and_user_pattern(spark):
    lines = log_lines(spark).where("stream_id = 's'")
    assert logs.detect_prefixed(lines).count() == 0
    extra = spark.createDataFrame([("s", 1, "app<5>(6) KeyError: 'x'"), ("s", 2, "oops code 7")], "stream_id string, line_no long, line string")
    hit = logs.detect_prefixed(extra).select("hit.*").first()
    assert (hit.pattern, hit.exception_type, hit.message, hit.version) == ("key_error", "KeyError", "'x'", "5")
    mine = logs.LinePattern.named("python_oops", r"OOPS code (?P<message>\d+)")
    second = logs.detect_lines(extra, [mine]).where("line_no = 2").select("hit.*").first()
    assert (second.pattern, second.exception_type, second.message) == ("python_oops", "UnknownException", "7")
