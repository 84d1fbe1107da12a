"""Python workers live on beside the JVM, so a task gives back what it no longer needs."""

import re
import subprocess
import sys

import pyarrow as pa
import pytest

from traceframe.llm import common

CODE = """
import re
from traceframe.llm import packing
from traceframe.llm.common import give_back
from traceframe.llm.spans import passes
import pyarrow as pa

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

encode = packing.encoder()
for _, _, texts in passes(pa.array([" ".join(f"word{i * 997 + j}" for j in range(200)) for i in range(1500)])):
    ids = encode(texts)
ids = texts = None
before = held()
give_back()
print(before - held())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc, trims glibc's heap")
def test_freed_memory_goes_back():
    said = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True).stdout
    assert float(re.findall(r"[-\d.]+", said)[-1]) > 20


class Given:
    """Stands for a frame: gives the function that a worker would run."""

    def mapInArrow(self, run, schema):
        return run


def test_every_task_gives_back_at_its_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    run = common.arrow_map(Given(), lambda batch: batch, "a bigint")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["a"])
    assert [b.num_rows for b in run(iter([batch, batch]))] == [2, 2]
    assert calls == [1]
