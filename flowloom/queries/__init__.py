"""The registered queries of the engine's own operators, each with the same in DuckDB SQL."""

from __future__ import annotations

from . import calls, events, graphs, loops, more, provider_calls, resumes, retrieval, streams, talk, text, tracing  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
