"""Exports in parallel parts that read back whole, partial paths by their n-grams, counts beside the flow."""

import glob
import json
import random

from pyspark.sql import functions as F

from traceframe.operators import checks, search
from traceframe.sinks import files
from traceframe.sinks import streaming as sinks


def test_one_array_in_many_parts(spark, tmp_path):
    events = spark.range(5000).select(F.col("id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit('],"'), i.cast("string"))).alias("context_lines"))
    path = str(tmp_path / "a")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert files.write_json_array(events.repartition(7), path, ["id"], keep=2) == 5000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(glob.glob(f"{path}/part-*"))
    data = json.loads("".join(open(p).read() for p in parts))
    assert len(parts) > 1 and [d["id"] for d in data] == list(range(5000)) and data[0]["context_lines"] == ['],"19', '],"20']
    back = files.read_json_array(spark, path, "id long, context_lines array<string>").collect()
    assert sorted(r.id for r in back) == list(range(5000)) and all(len(r.context_lines) == 2 for r in back)
    files.write_json_array(events.limit(0), path, ["id"])
    assert files.read_json_array(spark, path, "id long").count() == 0


def test_a_busy_url_becomes_several_files(spark, tmp_path):
    events = spark.createDataFrame([(i, None if i % 10 == 0 else "busy" if i % 10 < 8 else f"u{i % 3}") for i in range(1000)], "id long, url string")
    files.write_per_url(events, str(tmp_path / "u"), rows_per_file=100)
    sizes = {p.split("=")[1]: len(glob.glob(f"{p}/*.json")) for p in glob.glob(f"{tmp_path}/u/__folder=*")}
    assert sizes["busy"] > 2 and sizes["u1"] <= 1 + sizes["busy"] and spark.read.schema("id long").json(str(tmp_path / "u")).distinct().count() == 1000


def test_partial_paths_equal_a_plain_search(spark):
    random.seed(8)
    paths = ["".join(random.choice("ab/.") for _ in range(random.randrange(1, 9))) for _ in range(120)] + ["src/main.py", "lib/main.py", "main.py", "ü/漢字.py", "double", "double"]
    asked = [p[i : i + n] for p in paths for n in (1, 2, 3, 4, 6) for i in range(0, len(p), 3)] + ["nowhere", "", None, "main.py", "src/m", "漢", "漢字.p", "doubl"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    for exact in (True, False):
        want = {}
        for r in {a for a in asked if a}:
            hits = [p for p in paths if r in p]
            found = r if exact and r in hits else hits[0] if len(hits) == 1 else None
            if found is not None:
                want[r] = found
        got = search.partial_paths(frame, spark.createDataFrame([(a,) for a in asked], "request string"), exact_first=exact).collect()
        assert {r.request: r.file for r in got} == want and len(got) == len(want)
    assert search.partial_paths(frame.limit(0), spark.createDataFrame([("a",)], "request string")).count() == 0
    assert search.partial_paths(frame, spark.createDataFrame([], "request string")).count() == 0


def test_counts_beside_the_flow(spark):
    kept, seen = checks.filter_counted(spark.range(100), [F.col("id") % 3 == 0, F.when(F.col("id") > 50, F.lit(True))])
    assert kept.count() == 17 and seen.get == {"total": 100, "kept": 17}
    tally = sinks.Tally(spark)

    async def late(event):
        if event["id"] % 4 == 0:
            raise ValueError(event)

    sinks.counted_callback(late, tally)(spark.range(20), 0)
    assert (tally.done, tally.failed) == (15, 5)
