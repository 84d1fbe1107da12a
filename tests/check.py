"""Run queries against their SQL twins: ``python tests/check.py [sf_dir] [prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tests.harness import compare, duck  # noqa: E402
from traceframe.session import local_session  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = local_session("check", 8)
spark.sparkContext.setLogLevel("OFF")
con = duck(sf_dir)
bad = 0
oracles = contract.oracle_sql()
for name, fn in contract.queries().items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    begin = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in oracles:
            problem = compare(df, con, oracles[name])
            label = "ok" if problem is None else "DIFF " + problem[:900]
        else:
            label = f"rows {df.count()}"
    except Exception as error:  # noqa: BLE001
        label = "FAIL " + str(error)[:1500]
    bad += label.startswith(("DIFF", "FAIL"))
    print(f"{name:36s} {time.time() - begin:6.2f}s {label}", flush=True)
print("bad:", bad)
