"""Importing this module registers every query."""

from traceframe.plans import q_checks, q_code, q_edits, q_logs, q_mail, q_streaming, q_text  # noqa: F401
from traceframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
