"""Registered queries: each binds operators to tables, with its SQL where SQL can express it."""

from __future__ import annotations

from . import aggregate, embedding, evolution, knowledge, mass, matching, relational, scalars, similarity, streams, structures, text, timeseries, versions
from .registry import ORACLE, QUERIES

FLAGSHIP = "win_trend_states"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
