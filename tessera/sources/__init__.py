"""Readers and writers: history files, event archives, bundles, live feeds as Data Source classes."""

from .connectors import REGISTRY, FixedSnapshotSource, HttpFeedSource, connector
from .files import archive_signals, read_history, read_snapshots, replace_run, verify_bundle, write_bundle

__all__ = ["REGISTRY", "FixedSnapshotSource", "HttpFeedSource", "archive_signals", "connector", "read_history", "read_snapshots", "replace_run", "verify_bundle", "write_bundle"]
