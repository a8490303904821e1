"""Structured Streaming entry points."""

from .fixes import compile_from_snapshot, stream_fixes  # noqa: F401
