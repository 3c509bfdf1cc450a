"""Structured Streaming: chunks, incremental writers and event-time windows."""

from .batches import for_each_batch, read_stream, write_stream
from .windows import deduplicated, session_counts, windowed

__all__ = ["deduplicated", "for_each_batch", "read_stream", "session_counts", "windowed", "write_stream"]
