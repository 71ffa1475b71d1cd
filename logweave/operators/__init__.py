"""Relational operators: parse, count, funnel."""

from .count import count_patterns, count_summary, pattern_totals
from .funnel import (
    FunnelResult,
    analyze_funnel,
    funnel_drop_offs,
    funnel_progress,
    funnel_steps,
    funnel_summary,
)
from .parse import parse_entries, parse_stats

__all__ = [
    "parse_entries",
    "parse_stats",
    "count_patterns",
    "count_summary",
    "pattern_totals",
    "FunnelResult",
    "analyze_funnel",
    "funnel_progress",
    "funnel_steps",
    "funnel_drop_offs",
    "funnel_summary",
]
