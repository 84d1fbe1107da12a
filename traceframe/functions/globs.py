"""Shell globs as Java regexes, and path exclusion by glob lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named exclusion lists.
EXCLUSION_PRESETS: dict[str, tuple[str, ...]] = {
    "minimal": ("__pycache__", "*.pyc", ".git"),
    "dev": ("test*", "__pycache__", "*.pyc", ".git", ".venv", "venv", "build", "dist"),
    "comprehensive": (
        "test*", "*test*", ".*test*", "__pycache__", ".pytest_cache", ".mypy_cache", ".coverage", ".git", ".svn",
        ".hg", ".venv", "venv", "env", "*/site-packages/*", "build", "dist", "*.egg-info", "docs", "examples",
        "scripts", "tools", ".vscode", ".idea", "*.sublime-*", "*.pyc", "*.pyo", "*.pyd", "*.so", "*.log", "logs",
        "*/logs/*", "node_modules", "bower_components",
    ),
    "library": (
        "*/tests/**", "test_*", "*_test.py", "setup.py", "setup.cfg", "pyproject.toml", "tox.ini", "pytest.ini",
        "conftest.py", "docs", "examples", "benchmarks", "__pycache__", "build", "dist", ".git", ".github", ".gitlab",
    ),
}


def exclusion_preset(name: str) -> tuple[str, ...]:
    """Globs of a named preset; an unknown name excludes nothing."""
    return EXCLUSION_PRESETS.get(name, ())


def glob_regex(glob: str) -> str:
    """Unanchored regex of a glob: ``*`` and ``?`` also cross ``/``, matching is case-sensitive."""
    out, i = [], 0
    while i < len(glob):
        char = glob[i]
        close = glob.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close]
            negated = body.startswith("!")
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{inner}]")
            i = close
        else:
            out.append(re.escape(char))
        i += 1
    return "".join(out)


def matches_glob(path: Column, glob: str) -> Column:
    """The glob fits the whole path or its last part."""
    one = F.lit(f"(?s)^{glob_regex(glob)}$")
    return F.rlike(path, one) | F.rlike(F.element_at(F.split(path, "/"), -1), one)


def excluded(path: Column, globs: Sequence[str]) -> Column:
    """True when any glob fits the path, a part, a leading or a trailing run of parts, or has the path inside it.

    All those cases are one rule: the glob fits a stretch of the path that starts at the beginning or
    after a ``/`` and stops at the end or before a ``/``. The list becomes a single anchored regex.
    """
    if not globs:
        return F.lit(False)
    return F.rlike(path, F.lit("(?s)^(?:.*/)?(?:" + "|".join(glob_regex(g) for g in globs) + ")(?:/.*)?$"))
