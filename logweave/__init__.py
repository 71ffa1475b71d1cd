"""logweave: event-log pattern counts and ordered funnels as Spark DataFrame jobs."""

from .functions import (
    RegexSyntaxError,
    has_properties,
    json_object,
    match_subject,
    matches_pattern,
    matches_step,
    string_prop,
    translate,
    unicode_trim,
)
from .operators import (
    FunnelResult,
    analyze_funnel,
    count_patterns,
    count_summary,
    funnel_drop_offs,
    funnel_progress,
    funnel_steps,
    funnel_summary,
    parse_entries,
    parse_stats,
)
from .functions.clock import wall_clock_text
from .plans.report import count_report, funnel_report
from .sources import LINE_ORDER, SPLIT_CHUNK, entries_from_table, lines_from_text_column, read_log_lines, spread
from .streaming import FunnelStream, count_patterns_stream, read_log_stream
from .specs import FunnelSpec, ParserSpec, Step, go_layout

__all__ = [
    "ParserSpec",
    "FunnelSpec",
    "Step",
    "go_layout",
    "read_log_lines",
    "entries_from_table",
    "lines_from_text_column",
    "LINE_ORDER",
    "SPLIT_CHUNK",
    "parse_entries",
    "parse_stats",
    "count_patterns",
    "count_summary",
    "analyze_funnel",
    "FunnelResult",
    "funnel_progress",
    "funnel_steps",
    "funnel_drop_offs",
    "funnel_summary",
    "translate",
    "RegexSyntaxError",
    "unicode_trim",
    "json_object",
    "string_prop",
    "match_subject",
    "matches_pattern",
    "matches_step",
    "has_properties",
    "wall_clock_text",
    "spread",
    "count_report",
    "funnel_report",
    "read_log_stream",
    "count_patterns_stream",
    "FunnelStream",
]
