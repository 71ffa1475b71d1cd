"""Counts and funnels over a log directory that keeps growing (Structured Streaming)."""

from .incremental import FunnelStream, count_patterns_stream, read_log_stream

__all__ = ["read_log_stream", "count_patterns_stream", "FunnelStream"]
