"""All registered queries."""

from spanforge.queries import functions_q, generic, profile, sessions_q, streams_q  # noqa: F401
from spanforge.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
