"""A log-structured key-value analytics engine on Spark DataFrames."""

from .store import NOT_FOUND, CommitConflict, RunStore

__all__ = ["NOT_FOUND", "CommitConflict", "RunStore"]
