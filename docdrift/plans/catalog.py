"""Import every key module so the registry is complete."""

from . import q_diff, q_docs, q_edits, q_functions, q_mining, q_plan, q_requests  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
