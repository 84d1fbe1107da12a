"""Python functions run where the package is on no path of the workers."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as contract
from traceframe.session import local_session
spark = local_session("elsewhere", 2)
assert contract.queries()["x05_html_text"](spark, "/root/testdata/sf0.001").count() > 0
assert contract.queries()["e01_functions"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_package_reaches_workers_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
