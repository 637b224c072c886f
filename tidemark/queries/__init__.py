"""Named queries over the test tables, each with its oracle SQL where SQL can express it."""

from tidemark.queries import jobs, lake, logs, orders  # noqa: F401
from tidemark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
