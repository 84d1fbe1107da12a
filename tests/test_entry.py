"""The entry works without the operators for training text: both folders and the pipeline may be gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def copy_without(target, *gone):
    ignored = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, target, ignore=lambda folder, names: {*ignored(folder, names), *(n for n in names if os.path.relpath(os.path.join(folder, n), ROOT) in gone)})
    return str(target)


def run(folder, code):
    made = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": folder}, capture_output=True, text=True, timeout=120)
    return made.returncode, made.stdout + made.stderr


def test_entry_without_text_operators(tmp_path):
    folder = copy_without(tmp_path / "copy", "traceframe/llm", "tests/llm", "corpus_pipeline.py")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), [n for n in q if n.startswith('op') or n == 'pipeline'])"
    status, said = run(folder, code)
    assert status == 0 and said.strip().endswith("[]") and int(said.split()[0]) > 150
    status, said = run(folder, "import pytest; raise SystemExit(pytest.main(['--collect-only', '-q', 'tests']))")
    assert status == 0, said[-2000:]


def test_other_missing_modules_are_errors(tmp_path):
    folder = copy_without(tmp_path / "copy", "traceframe/operators")
    status, said = run(folder, "import __spark_entry__")
    assert status != 0 and "traceframe.operators" in said
