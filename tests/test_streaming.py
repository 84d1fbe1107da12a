"""Live forms equal batch forms when traces, windows and counts cross micro-batches, files repeat and the query restarts."""

from pyspark.sql import functions as F

from tests.test_ordered import LOG
from traceframe.operators import alerts, logs
from traceframe.sinks import streaming as sinks
from traceframe.sources import text_lines
from traceframe.streaming import live
from traceframe.streaming.carry import Carry

SHAPE = "stream_id string, line_no long, line string, ts timestamp"


def lines(spark):
    rows = [(s, i, line) for s in ("s", "t") for i, line in enumerate(LOG * 2)]
    df = spark.createDataFrame(rows, "stream_id string, line_no long, line string")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("line_no")))


def slices(df, column, cuts):
    return [df.where((F.col(column) >= a) & (F.col(column) < b)) for a, b in zip(cuts, cuts[1:])]


def flat(df):
    out = df.select(
        "stream_id", "line_no", "pattern", "exception_type", "message", "severity", "total_exceptions_found",
        F.array_join("stacktrace", "|").alias("stack"), F.array_join("context_lines", "|").alias("context"),
    )
    return sorted(map(tuple, out.collect()))


def test_exceptions_across_batches_and_restarts(spark, tmp_path):
    src, all_lines = str(tmp_path / "in"), lines(spark)
    numbered = logs.number_lines(all_lines).withColumn("line_number", F.col("line_no"))
    events = logs.exception_events(all_lines)
    # line numbers are dense here but for the offset of one, so context can be joined after shifting
    shifted = events.withColumn("line_no", F.col("line_no") + 1)
    want = flat(logs.with_context(shifted, numbered, 4).withColumn("line_no", F.col("line_no") - 1))
    out, check, carry = str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "carry")
    for part in slices(all_lines, "line_no", [0, 2, 8, 11, 20, 34]):
        part.repartition(1).write.mode("append").parquet(src)
        # a new query per file: everything it knows comes from the checkpoint and the carry table
        stream = spark.readStream.schema(all_lines.schema).parquet(src)
        run = live.live_exceptions(sinks.folder(out), Carry(carry), context=4)
        summary = live.run_bounded(live.start(stream, run, check, available_now=True))
        assert summary["batches"] >= 1
    assert flat(spark.read.parquet(out)) == want


def test_replayed_batch_changes_nothing(spark, tmp_path):
    all_lines = lines(spark)
    first, second = slices(all_lines, "line_no", [0, 9, 34])
    run = live.live_exceptions(sinks.folder(str(tmp_path / "out")), Carry(str(tmp_path / "carry")), context=3)
    run(first, 0)
    run(second, 1)
    once = flat(spark.read.parquet(str(tmp_path / "out")))
    run(second, 1)
    assert flat(spark.read.parquet(str(tmp_path / "out"))) == once


def test_alerts_across_batches(spark, tmp_path):
    rows = [("u" if i % 3 else "v", i * 40, i) for i in range(60)]
    events = spark.createDataFrame(rows, "url string, s long, id long").select("url", F.timestamp_seconds("s").alias("ts"), "id")
    trailing = live.live_trailing_alerts(sinks.folder(str(tmp_path / "a")), Carry(str(tmp_path / "ca")), ["url"], "ts", 300, 3)
    counted = live.live_count_alerts(sinks.folder(str(tmp_path / "b")), Carry(str(tmp_path / "cb")), ["url"], "ts", "id", 4)
    for n, part in enumerate(slices(events, "id", [0, 7, 8, 31, 60])):
        trailing(part, n)
        counted(part, n)
    got = spark.read.parquet(str(tmp_path / "a")).select("url", "id", "n_recent").collect()
    want = alerts.trailing_alerts(events, ["url"], "ts", 300, 3).select("url", "id", "n_recent").collect()
    assert sorted(got) == sorted(want) and want
    got = spark.read.parquet(str(tmp_path / "b")).select("url", "id", "n_event").collect()
    want = alerts.count_reset_alerts(events, ["url"], "ts", "id", 4).select("url", "id", "n_event").collect()
    assert sorted(got) == sorted(want) and want


def test_old_carry_versions_are_dropped(spark, tmp_path):
    carry = Carry(str(tmp_path / "c"), keep=2)
    for i in range(5):
        carry.save(spark.range(i + 1), i)
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["version=3", "version=4"]
    assert carry.before(spark, 5).count() == 5 and carry.before(spark, 0) is None


def test_text_stream_and_bounded_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("ValueError: x\n\nfine\n")
    stream = text_lines.stream_lines(spark, str(tmp_path / "in"))
    seen = []
    query = live.start(stream, lambda b, i: seen.append(b.count()), str(tmp_path / "ck"), every="1 second")
    query.processAllAvailable()
    summary = live.run_bounded(query, 0.5)
    assert not query.isActive and sum(seen) == 2 and summary["input_rows"] >= 2
