"""The registered workloads: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every workload reads the given tables in full (or log lines Spark derives from
them), so its work grows with the data.  ``ORACLES`` in ``oracle.py`` holds the
matching DuckDB SQL for each name.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import wall_clock_text
from ..functions.match import has_properties, match_subject, matches_step
from ..functions.payload import string_prop
from ..operators.count import count_patterns, count_summary
from ..operators.funnel import analyze_funnel
from ..operators.parse import barrier, parse_entries, parse_stats
from ..session import Scratch
from ..sources.balance import spread
from ..sources.table import entries_from_table, lines_from_text_column
from ..sources.text import LINE_ORDER, SPLIT_CHUNK, read_log_lines
from ..specs import FunnelSpec, ParserSpec, Step, go_layout
from .derived import EVENT_LINE_FORMAT, EVENT_LINE_REGEX, PAYLOAD_REGEX, clock_lines, fraction_lines, logcat_lines, repeated_key_payload, syslog_lines, write_lines
from .report import count_report

# The pattern sets, funnels and parser specs of the workloads
# (shared with the oracle SQL).
EVENT_PATTERNS = ["view", "click", "purchase", "sign", "error|fail"]
OVERLAPPING_PATTERNS = ["i", "^c", "e$", "[aeiou]{2}", "."]
DUPLICATE_PATTERNS = ["view", "view", "^v"]
DOCUMENT_PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\d{1,3}(?:[.]\d{1,3}){2,3}",
    r"\+?\d[\d ()-]{7,}\d",
    r"token\s*=\s*\"[0-9a-f]{16,}\"",
    r"(?i)licen[cs]e",
    r"[[:upper:]]{3,}",
    r"[#$%&*]{3}",
    r"^\p{Lu}",
    r"\ble\b",
    r"(?i)ét",
]
PAYLOAD_PATTERNS = ["view", "click", "purchase", "by user_", "^null$", "k"]
MAIN_FUNNEL = ["view", "click", "purchase"]
OVERLAP_FUNNEL = ["i", "c", "e"]
TWENTY_FUNNEL = ["view", "click", "purchase", "signup", "error"] * 4
DOCUMENT_FUNNEL = [r"(?i)licen[cs]e", r"@", r"\d[.]\d+[.]\d"]
PROPS_FUNNEL = [("view", {"user": "^u1"}), ("click", {}), ("purchase", {"user": "[02468]$"})]
CONVERSATION_FUNNEL = ["^user$", "^assistant$", "^user$", "^assistant$"]
CONVERSATION_PATTERNS = [r"\?$", r"(?i)\bdie\b", r"[ÀÉÈ]", r"^\p{Lu}", r"\.$", r"[^\x00-\x7F]{3}"]
PAGE_PATTERNS = [r"<a href=", r"<script", r"(?i)</?p>", r"&amp;", r"https?://[^\"]+", r"\btrack\(\d+\)"]
PAGE_TITLE_REGEX = r"<title>([^<]*)</title>"
LIMITS = {"funnel_limit_1": 1, "funnel_limit_200": 200, "funnel_limit_large": 10**9, "funnel_limit_negative": -1}

LOGCAT_SPEC = ParserSpec(
    timestamp_format=EVENT_LINE_FORMAT, event_regex=PAYLOAD_REGEX, json_extraction=True, log_line_regex=EVENT_LINE_REGEX
)
CLOCK_REGEX = r"^\[(\d\dh\d\dm\d\d)\] ([A-Z]+) (.*)$"
CLOCK_FORMAT = "HH'h'mm'm'ss"
CLOCK_SPEC = ParserSpec(timestamp_format=CLOCK_FORMAT, log_line_regex=CLOCK_REGEX)
LOOSE_CLOCK_REGEX = r"^\[(\S+)\] (.*)$"
LOOSE_CLOCK_SPEC = ParserSpec(timestamp_format=CLOCK_FORMAT, log_line_regex=LOOSE_CLOCK_REGEX)
FRACTION_REGEX = r"^\{(\S+)\} (.*)$"
FRACTION_SPEC = ParserSpec(timestamp_format="yyyy-MM-dd'T'HH:mm:ss.SSS", log_line_regex=FRACTION_REGEX)
SYSLOG_REGEX = r"^([A-Z][a-z]+ +\d+ \d+:\d+:\d+) (.*)$"
SYSLOG_SPEC = ParserSpec(timestamp_format=go_layout("Jan _2 15:04:05"), log_line_regex=SYSLOG_REGEX)
# repeats and alternatives inside repeated groups: beyond what java.util.regex can run on long lines
DEEP_PATTERNS = [r"^(?:\w|-)*$", r"^(?:[^.]|\.[^.])*$", r"(?:\w+\s?)+[.]$", r"(?:[A-Z]+!!\s?){3,}", r"^(?:(?:\p{L}|\p{M})+[\s,.]*)*$"]
# repeats that can trade characters: a backtracking search takes a power of the line's length
AMBIGUOUS_PATTERNS = [r".*a.*e.*i.*o.*u$", r"\w+\s\w+,.*\w+\.$", r"(\S*)e(\S*)e(\S*)!!", r"\d+[a-z]", r"^(.*) (.*)###$"]
# a thousand patterns: words of two syllables, some with a repeat, an alternative or a case flag around them
_SYLLABLES = "re tion ment an the ver ung der ich la que en est con pro ar er in al os".split()
MANY_PATTERNS = [
    [a + b, rf"\b{a}{b}", rf"{a}{b}\w*\.$", rf"{a}(?:{b})+", rf"{a}{b}[aeiou]"][(i + j) % 5] for i, a in enumerate(_SYLLABLES) for j, b in enumerate(_SYLLABLES)
] + [rf"{a}{b}{c}" for a in _SYLLABLES[:10] for b in _SYLLABLES[:10] for c in _SYLLABLES[:6]]
DOC_LINE_REGEX = r"^(\p{Lu})(\S*)\s(.*)$"
EVENT_ORDER = ["ts", "event_id"]
DOC_ORDER = ["doc_id", "line_no"]


def funnel_of(patterns, name="funnel") -> FunnelSpec:
    return FunnelSpec(name, tuple(Step(f"s{i + 1}_{p}", p) for i, p in enumerate(patterns)))


def props_funnel() -> FunnelSpec:
    return FunnelSpec("props", tuple(Step(f"s{i + 1}_{p}", p, props) for i, (p, props) in enumerate(PROPS_FUNNEL)))


# -- sources -------------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def event_entries(spark, sf_dir) -> DataFrame:
    """``events`` as entries: the event type is the message, no payload."""
    return entries_from_table(table(spark, sf_dir, "events"), message="event_type", ts="ts", keep=["event_id"])


def event_log_lines(spark, sf_dir, partitions: int | None = None) -> DataFrame:
    """Lines derived from ``events``, scanned as stored or spread over ``partitions`` tasks."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "props")
    lines = logcat_lines(spread(events, partitions))
    # the line text is built once; the parser's filters then test the built text
    return barrier(lines, [F.col("ts").alias("event_ts"), F.col("event_id")], value=F.col("value"))


def logcat_entries(spark, sf_dir, partitions: int | None = None) -> DataFrame:
    return parse_entries(event_log_lines(spark, sf_dir, partitions), LOGCAT_SPEC)


def document_lines(spark, sf_dir, partitions: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines_from_text_column(spread(docs, partitions), "text", keep=["doc_id"])


def document_entries(spark, sf_dir, partitions: int | None = None) -> DataFrame:
    return parse_entries(document_lines(spark, sf_dir, partitions))


def conversation_lines(spark, sf_dir) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return lines_from_text_column(convs, "text", keep=["conv_id", "turn"])


def page_lines(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return lines_from_text_column(pages, "html", keep=["page_id"])


def _ts_text(c="ts"):
    return wall_clock_text(c, "yyyy-MM-dd HH:mm:ss.SSS")


# -- counts -----------------------------------------------------------------------------
def q_count_patterns(spark, d):
    return count_patterns(event_entries(spark, d), EVENT_PATTERNS)


def q_count_overlapping(spark, d):
    return count_patterns(event_entries(spark, d), OVERLAPPING_PATTERNS)


def q_count_duplicate_patterns(spark, d):
    return count_patterns(event_entries(spark, d), DUPLICATE_PATTERNS)


def q_count_rates(spark, d):
    return count_patterns(event_entries(spark, d), EVENT_PATTERNS, with_rates=True)


def q_count_summary(spark, d):
    return count_summary(event_entries(spark, d), OVERLAPPING_PATTERNS)


def q_count_empty(spark, d):
    lines = event_log_lines(spark, d)
    never = ParserSpec(log_line_regex=r"^NEVER (\d+)$")
    return count_patterns(parse_entries(lines, never), EVENT_PATTERNS, with_rates=True)


def q_count_payload(spark, d, partitions=None):
    return count_patterns(logcat_entries(spark, d, partitions), PAYLOAD_PATTERNS)


def q_count_documents(spark, d, partitions=None):
    return count_patterns(document_entries(spark, d, partitions), DOCUMENT_PATTERNS, with_rates=True)


def q_count_deep_patterns(spark, d, partitions=None):
    return count_patterns(document_entries(spark, d, partitions), DEEP_PATTERNS)


def q_count_ambiguous_patterns(spark, d):
    return count_patterns(document_entries(spark, d), AMBIGUOUS_PATTERNS, with_rates=True)


def q_count_1000_patterns(spark, d, partitions=None):
    return count_patterns(document_entries(spark, d, partitions), MANY_PATTERNS)


def q_count_conversation_lines(spark, d):
    return count_patterns(parse_entries(conversation_lines(spark, d)), CONVERSATION_PATTERNS, with_rates=True)


def q_count_page_html(spark, d):
    return count_patterns(parse_entries(page_lines(spark, d)), PAGE_PATTERNS)


def q_parse_page_titles(spark, d):
    e = parse_entries(page_lines(spark, d), ParserSpec(log_line_regex=PAGE_TITLE_REGEX))
    return e.select("page_id", "line_no", "message")


REPORT_SCHEMA = "total_events_analyzed bigint, pattern_counts array<struct<pattern:string,count:bigint>>"


def _count_report_rows(report):
    """The emitted JSON document, read back: one row per pattern (one row in all for an empty list)."""
    doc = report.select(F.from_json("report", REPORT_SCHEMA).alias("d")).select("d.*")
    rows = doc.select("total_events_analyzed", F.size("pattern_counts").alias("n_patterns"), F.posexplode_outer("pattern_counts").alias("_i", "_p"))
    return rows.select(
        "total_events_analyzed", "n_patterns", (F.col("_i") + 1).cast("int").alias("pattern_index"), "_p.pattern", "_p.count"
    )


def q_count_report(spark, d):
    return _count_report_rows(count_report(event_entries(spark, d), EVENT_PATTERNS))


def q_count_report_empty(spark, d):
    never = parse_entries(event_log_lines(spark, d), ParserSpec(log_line_regex=r"^NEVER (\d+)$"))
    return _count_report_rows(count_report(never, EVENT_PATTERNS))


# -- funnels --------------------------------------------------------------------------------
def _event_funnel(spark, d, patterns, limit=0):
    return analyze_funnel(event_entries(spark, d), funnel_of(patterns), order_by=EVENT_ORDER, limit=limit)


def q_funnel_steps(spark, d):
    return _event_funnel(spark, d, MAIN_FUNNEL).steps()


def q_funnel_drop_offs(spark, d):
    return _event_funnel(spark, d, MAIN_FUNNEL).drop_offs()


def q_funnel_summary(spark, d):
    return _event_funnel(spark, d, MAIN_FUNNEL).summary()


def _limit_query(name):
    def q(spark, d):
        r = _event_funnel(spark, d, MAIN_FUNNEL, limit=LIMITS[name])
        return r.steps() if name in ("funnel_limit_1", "funnel_limit_negative") else r.summary()

    q.__name__ = f"q_{name}"
    return q


def q_funnel_overlapping_steps(spark, d):
    return _event_funnel(spark, d, OVERLAP_FUNNEL).steps()


def q_funnel_20_steps(spark, d):
    return _event_funnel(spark, d, TWENTY_FUNNEL).steps()


def q_funnel_20_drop_offs(spark, d):
    return _event_funnel(spark, d, TWENTY_FUNNEL).drop_offs()


def q_funnel_empty(spark, d):
    entries = parse_entries(event_log_lines(spark, d), ParserSpec(log_line_regex=r"^NEVER (\d+)$"))
    return analyze_funnel(entries, funnel_of(MAIN_FUNNEL), order_by=["event_ts", "event_id"]).steps()


def q_funnel_by_user(spark, d):
    """One walk per user: each user's steps."""
    entries = entries_from_table(table(spark, d, "events"), message="event_type", ts="ts", keep=["user_id", "event_id"])
    r = analyze_funnel(entries, funnel_of(MAIN_FUNNEL), order_by=EVENT_ORDER, partition_by=["user_id"])
    return r.steps()


def q_funnel_by_user_summary(spark, d):
    """The users' walks with a limit of three rounds each."""
    entries = entries_from_table(table(spark, d, "events"), message="event_type", ts="ts", keep=["user_id", "event_id"])
    r = analyze_funnel(entries, funnel_of(TWENTY_FUNNEL), order_by=EVENT_ORDER, partition_by=["user_id"], limit=3)
    return r.summary()


def q_funnel_required_props(spark, d):
    r = analyze_funnel(logcat_entries(spark, d), props_funnel(), order_by=["event_ts", "event_id"])
    return r.steps()


def q_funnel_documents(spark, d):
    return analyze_funnel(document_entries(spark, d), funnel_of(DOCUMENT_FUNNEL), order_by=DOC_ORDER).steps()


def q_funnel_conversations(spark, d):
    """Role sequence user -> assistant -> user -> assistant over all turns in (conv_id, turn) order."""
    convs = table(spark, d, "conversations")
    entries = entries_from_table(convs, message="role", keep=["conv_id", "turn"])
    return analyze_funnel(entries, funnel_of(CONVERSATION_FUNNEL), order_by=["conv_id", "turn"]).steps()


def q_funnel_text_log(spark, d):
    """Funnel over a real text log: derived lines are written as text files in
    event order, read back with the text source and walked per file split."""
    entries = parse_entries(read_log_lines(spark, _written_log(spark, d)), LOGCAT_SPEC)
    return analyze_funnel(entries, funnel_of(MAIN_FUNNEL), order_by=LINE_ORDER, chunk_by=SPLIT_CHUNK).steps()


def _written_log(spark, d) -> str:
    return write_lines(logcat_lines(table(spark, d, "events")), Scratch(spark, "lines").path("log"))


def q_text_log_scan(spark, d):
    """Text source: every derived line comes back exactly once, CR-free."""
    return read_log_lines(spark, _written_log(spark, d)).select("value")


def q_text_log_parse_stats(spark, d):
    return parse_stats(read_log_lines(spark, _written_log(spark, d)), LOGCAT_SPEC)


FUNNEL_REPORT_SCHEMA = (
    "funnel_name string, total_events_analyzed bigint, funnel_completed boolean, "
    "steps array<struct<name:string,event_count:bigint,percentage:double>>, "
    "drop_offs array<struct<`from`:string,`to`:string,events_lost:bigint,drop_off_rate:double>>"
)


def _funnel_report_rows(report):
    """The emitted JSON document, read back: one row per step and drop-off (one row in all for empty lists)."""
    doc = report.select(F.from_json("report", FUNNEL_REPORT_SCHEMA).alias("d")).select("d.*")

    def row(section, i, name, to, n, rate):
        return F.struct(F.lit(section).alias("section"), (i + 1).alias("idx"), name.alias("name"), to.alias("to"), n.alias("n"), rate.alias("rate"))

    steps = F.transform("steps", lambda s, i: row("step", i, s["name"], F.lit(None).cast("string"), s["event_count"], s["percentage"]))
    drops = F.transform("drop_offs", lambda s, i: row("drop_off", i, s["from"], s["to"], s["events_lost"], s["drop_off_rate"]))
    return doc.select(
        "funnel_name", "total_events_analyzed", "funnel_completed", F.size("steps").alias("n_steps"),
        F.size("drop_offs").alias("n_drop_offs"), F.explode_outer(F.concat(steps, drops)).alias("_r"),
    ).select("funnel_name", "total_events_analyzed", "funnel_completed", "n_steps", "n_drop_offs", "_r.*")


def q_funnel_report(spark, d):
    return _funnel_report_rows(_event_funnel(spark, d, MAIN_FUNNEL).report())


def q_funnel_report_empty(spark, d):
    never = parse_entries(event_log_lines(spark, d), ParserSpec(log_line_regex=r"^NEVER (\d+)$"))
    return _funnel_report_rows(analyze_funnel(never, funnel_of(MAIN_FUNNEL), order_by=["event_ts", "event_id"]).report())


# -- parsing ------------------------------------------------------------------------------
def q_parse_logcat(spark, d, partitions=None):
    e = logcat_entries(spark, d, partitions)
    return e.select(
        "event_id", _ts_text().alias("ts"), "level", "tag", "pid", "tid", "message",
        F.col("event_data").isNotNull().alias("has_payload"),
        string_prop(F.col("event_data"), "event").alias("event"),
        string_prop(F.col("event_data"), "user").alias("user"),
    )


def q_parse_three_group(spark, d):
    events = table(spark, d, "events").select("ts", "event_id", "user_id", "event_type")
    lines = clock_lines(events).withColumnRenamed("ts", "event_ts")
    e = parse_entries(lines, CLOCK_SPEC)
    return e.select("event_id", _ts_text().alias("ts"), "level", "tag", "pid", "tid", "message")


def q_parse_bad_timestamp(spark, d):
    events = table(spark, d, "events").select("ts", "event_id", "user_id", "event_type")
    lines = clock_lines(events, broken_every=7).withColumnRenamed("ts", "event_ts")
    e = parse_entries(lines, LOOSE_CLOCK_SPEC)
    return e.select("event_id", _ts_text().alias("ts"), "pid", "message")


def q_parse_syslog_days(spark, d):
    events = table(spark, d, "events").select("ts", "event_id", "user_id", "event_type")
    e = parse_entries(syslog_lines(events).withColumnRenamed("ts", "event_ts"), SYSLOG_SPEC)
    return e.select("event_id", _ts_text().alias("ts"), "message")


def q_parse_short_fractions(spark, d):
    """Every third clock shows one digit of its fraction less than the format's three: it is no timestamp, so it is the message."""
    events = table(spark, d, "events").select("ts", "event_id", "user_id", "event_type")
    e = parse_entries(fraction_lines(events).withColumnRenamed("ts", "event_ts"), FRACTION_SPEC)
    return e.select("event_id", _ts_text().alias("ts"), "message")


def q_funnel_with_parse_stats(spark, d):
    """A funnel over a text log and the parse counters, from one scan of the log."""
    stats = Observation("lines")
    entries = parse_entries(read_log_lines(spark, _written_log(spark, d)), LOGCAT_SPEC, stats=stats)
    progress = analyze_funnel(entries, funnel_of(MAIN_FUNNEL), order_by=LINE_ORDER, chunk_by=SPLIT_CHUNK).summary()
    seen = stats.get  # three numbers
    return progress.select("*", *[F.lit(seen[c]).cast("bigint").alias(c) for c in ("total_lines", "parsed_entries", "skipped_lines")])


def q_parse_whole_line(spark, d):
    return document_entries(spark, d).select("doc_id", "line_no", "message", "level", "pid")


def q_parse_document_fields(spark, d):
    e = parse_entries(document_lines(spark, d), ParserSpec(log_line_regex=DOC_LINE_REGEX))
    return e.select("doc_id", "line_no", "pid", "tid", "message")


def q_parse_stats(spark, d):
    return parse_stats(document_lines(spark, d), ParserSpec(log_line_regex=DOC_LINE_REGEX))


def q_nonblank_lines(spark, d, partitions=None):
    return document_entries(spark, d, partitions).select("doc_id", "line_no", F.col("message").alias("line"))


# -- payloads and predicates -----------------------------------------------------------------
def q_payload_extract(spark, d):
    e = logcat_entries(spark, d)
    return e.select(
        "event_id",
        F.col("event_data").isNotNull().alias("has_payload"),
        string_prop(F.col("event_data"), "event").alias("event"),
        string_prop(F.col("event_data"), "user").alias("user"),
        F.map_contains_key(F.col("event_data"), F.lit("k")).alias("has_k"),
    )


def q_match_subject(spark, d):
    e = logcat_entries(spark, d)
    return e.select("event_id", match_subject(F.col("message"), F.col("event_data")).alias("subject"))


def q_step_filter(spark, d):
    e = logcat_entries(spark, d)
    subject = match_subject(F.col("message"), F.col("event_data"))
    step = Step("viewish", "view|click")
    return e.filter(matches_step(subject, F.col("event_data"), step)).select("event_id", subject.alias("subject"))


def q_required_properties(spark, d):
    e = logcat_entries(spark, d)
    return e.filter(has_properties(F.col("event_data"), {"user": "^u1", "event": "v"})).select("event_id")


def q_numeric_property(spark, d):
    """``props.k`` is a JSON number: the key is there, and a property test on it never holds."""
    e = entries_from_table(table(spark, d, "events"), message="event_type", payload_json="props", keep=["event_id"])
    return e.select(
        "event_id",
        F.coalesce(F.map_contains_key("event_data", F.lit("k")), F.lit(False)).alias("has_k"),
        has_properties(F.col("event_data"), {"k": "."}).alias("k_matches"),
    )


def q_payload_repeated_keys(spark, d):
    """Payloads that repeat a key, at the top (the last value stands) or further down, or hold a number beyond double."""
    events = table(spark, d, "events").withColumn("props", repeated_key_payload())
    e = entries_from_table(events, message="event_type", payload_json="props", keep=["event_id"])
    return e.select(
        "event_id", F.col("event_data").isNotNull().alias("has_payload"), string_prop(F.col("event_data"), "user").alias("user"),
        match_subject(F.col("message"), F.col("event_data")).alias("subject"),
    )


def q_table_payload_count(spark, d):
    e = entries_from_table(table(spark, d, "events"), message="event_type", payload_json="props", keep=["event_id"])
    return count_patterns(e, EVENT_PATTERNS)


QUERIES = {
    "count_patterns": q_count_patterns,
    "count_overlapping": q_count_overlapping,
    "count_duplicate_patterns": q_count_duplicate_patterns,
    "count_rates": q_count_rates,
    "count_summary": q_count_summary,
    "count_empty": q_count_empty,
    "count_payload": q_count_payload,
    "count_documents": q_count_documents,
    "count_deep_patterns": q_count_deep_patterns,
    "count_ambiguous_patterns": q_count_ambiguous_patterns,
    "count_1000_patterns": q_count_1000_patterns,
    "count_report": q_count_report,
    "count_report_empty": q_count_report_empty,
    "table_payload_count": q_table_payload_count,
    "funnel_steps": q_funnel_steps,
    "funnel_drop_offs": q_funnel_drop_offs,
    "funnel_summary": q_funnel_summary,
    **{name: _limit_query(name) for name in LIMITS},
    "funnel_overlapping_steps": q_funnel_overlapping_steps,
    "funnel_20_steps": q_funnel_20_steps,
    "funnel_20_drop_offs": q_funnel_20_drop_offs,
    "funnel_empty": q_funnel_empty,
    "funnel_required_props": q_funnel_required_props,
    "funnel_by_user": q_funnel_by_user,
    "funnel_by_user_summary": q_funnel_by_user_summary,
    "funnel_documents": q_funnel_documents,
    "funnel_text_log": q_funnel_text_log,
    "funnel_conversations": q_funnel_conversations,
    "count_conversation_lines": q_count_conversation_lines,
    "count_page_html": q_count_page_html,
    "parse_page_titles": q_parse_page_titles,
    "funnel_report": q_funnel_report,
    "funnel_report_empty": q_funnel_report_empty,
    "text_log_scan": q_text_log_scan,
    "text_log_parse_stats": q_text_log_parse_stats,
    "funnel_with_parse_stats": q_funnel_with_parse_stats,
    "parse_logcat": q_parse_logcat,
    "parse_three_group": q_parse_three_group,
    "parse_bad_timestamp": q_parse_bad_timestamp,
    "parse_syslog_days": q_parse_syslog_days,
    "parse_short_fractions": q_parse_short_fractions,
    "parse_whole_line": q_parse_whole_line,
    "parse_document_fields": q_parse_document_fields,
    "parse_stats": q_parse_stats,
    "nonblank_lines": q_nonblank_lines,
    "payload_extract": q_payload_extract,
    "match_subject": q_match_subject,
    "step_filter": q_step_filter,
    "required_properties": q_required_properties,
    "numeric_property": q_numeric_property,
    "payload_repeated_keys": q_payload_repeated_keys,
}
