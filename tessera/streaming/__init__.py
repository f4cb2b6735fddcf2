"""Structured Streaming forms of the polling workers: windows, deduplication, change detection, state."""

from .events import SCHEMA, changes, closed_windows, drain, late_split, observed_once, read_events, session_groups, sliding_counts, split_bad, weekly_counts
from .state import lifecycle_stream

__all__ = ["SCHEMA", "changes", "closed_windows", "drain", "late_split", "lifecycle_stream", "observed_once", "read_events", "session_groups", "sliding_counts", "split_bad", "weekly_counts"]
