"""DuckDB SQL restating each workload independently (DuckDB's regexes are RE2).

The funnel oracle walks the entries in order with ``list_reduce`` over a bit
mask per entry, a sequential formulation unrelated to the Spark fold.
"""

from __future__ import annotations

from ..functions.text import WHITE_SPACE
from .derived import EVENT_LINE_REGEX, PAYLOAD_REGEX
from .workloads import (
    AMBIGUOUS_PATTERNS,
    CLOCK_REGEX,
    CONVERSATION_FUNNEL,
    CONVERSATION_PATTERNS,
    DEEP_PATTERNS,
    PAGE_PATTERNS,
    PAGE_TITLE_REGEX,
    DOC_LINE_REGEX,
    DOCUMENT_FUNNEL,
    DOCUMENT_PATTERNS,
    DUPLICATE_PATTERNS,
    EVENT_PATTERNS,
    LIMITS,
    LOOSE_CLOCK_REGEX,
    MANY_PATTERNS,
    MAIN_FUNNEL,
    OVERLAP_FUNNEL,
    OVERLAPPING_PATTERNS,
    PAYLOAD_PATTERNS,
    PROPS_FUNNEL,
    TWENTY_FUNNEL,
)

__all__ = ["ORACLES"]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"


def utrim(expr: str) -> str:
    return f"trim({expr}, {WS})"


def rx(expr: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({expr}, {lit(pattern)}), false)"


# -- sources ---------------------------------------------------------------------------
EVENT_ENTRIES = "SELECT event_id, ts, coalesce(event_type, '') AS message FROM events"

LOGCAT_LINES = """SELECT ts AS event_ts, event_id,
  strftime(ts, '%m/%d %H:%M:%S') || '.' || lpad(CAST((microsecond(ts) // 1000) % 1000 AS VARCHAR), 3, '0')
  || ' [' || CAST(user_id AS VARCHAR) || ':' || CAST(event_id AS VARCHAR) || '] '
  || CASE WHEN event_type = 'error' THEN 'E' ELSE 'I' END || ' metrics - '
  || CASE event_id % 6
       WHEN 0 THEN '{"event": "' || event_type || '", "user": "u' || CAST(user_id AS VARCHAR) || '"}'
       WHEN 1 THEN '{"event": ' || CAST(user_id AS VARCHAR) || ', "type": "' || event_type || '"}'
       WHEN 2 THEN '{"event": null, "user": "u' || CAST(user_id AS VARCHAR) || '"}'
       WHEN 3 THEN coalesce(props, '{}')
       WHEN 4 THEN event_type || ' by user_' || CAST(user_id AS VARCHAR)
       ELSE 'null' END AS value
FROM events"""


def _json_kind(c: str) -> str:
    return f"CASE WHEN json_valid({c}) THEN json_type({c}) END"


# logcat lines parsed: groups, message, payload (as JSON text) and subject
LOGCAT_ENTRIES = f"""
WITH l AS ({LOGCAT_LINES}),
t AS (SELECT event_ts, event_id, value, {utrim('value')} AS line FROM l),
g AS (
  SELECT event_ts, event_id, value,
    {', '.join(f"regexp_extract(line, {lit(EVENT_LINE_REGEX)}, {i}) AS g{i}" for i in range(1, 7))}
  FROM t WHERE line <> '' AND {rx('line', EVENT_LINE_REGEX)}
),
e AS (
  SELECT *,
    try_strptime('2000 ' || g1, '%Y %m/%d %H:%M:%S.%g') AS ts,
    CASE WHEN g6 <> '' THEN g6
         WHEN g1 <> '' AND try_strptime('2000 ' || g1, '%Y %m/%d %H:%M:%S.%g') IS NULL THEN g1
         ELSE g6 END AS message,
    CASE WHEN {rx('value', PAYLOAD_REGEX)}
         THEN {utrim(f"regexp_extract(value, {lit(PAYLOAD_REGEX)}, 1)")} END AS cand
  FROM g
),
p AS (
  SELECT *,
    CASE WHEN {_json_kind('cand')} = 'OBJECT' THEN cand
         WHEN {_json_kind('cand')} = 'NULL' THEN NULL
         WHEN {_json_kind('message')} = 'OBJECT' THEN message END AS payload
  FROM e
)
SELECT *,
  CASE WHEN payload IS NULL OR json_type(payload, '$.event') IS NULL THEN message
       WHEN json_type(payload, '$.event') = 'VARCHAR' THEN json_extract_string(payload, '$.event') END AS subject
FROM p
"""


def _prop(key: str) -> str:
    path = lit(f"$.{key}")
    return f"CASE WHEN json_type(payload, {path}) = 'VARCHAR' THEN json_extract_string(payload, {path}) END"


def lines_sql(table: str, keys: str, text: str) -> str:
    """Lines of a text column: split on \\n, no piece after a final newline, one \\r dropped."""
    return f"""
SELECT {keys}, line_no, regexp_replace(value, '\\r$', '') AS value FROM (
  SELECT {keys}, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line_no, unnest(parts) AS value, len(parts) AS n
  FROM (SELECT {keys}, string_split({text}, chr(10)) AS parts FROM {table} WHERE {text} IS NOT NULL)
) WHERE NOT (line_no = n - 1 AND value = '')
"""


def entries_sql(lines: str, keys: str) -> str:
    """Default parser: the Unicode-trimmed line is the message; blank lines dropped."""
    return f"""
SELECT {keys}, line_no, line AS message FROM (
  SELECT {keys}, line_no, {utrim('value')} AS line FROM ({lines})
) WHERE line <> ''
"""


DOCUMENT_LINES_CR = lines_sql("documents", "doc_id", "text")
DOCUMENT_ENTRIES = entries_sql(DOCUMENT_LINES_CR, "doc_id")
CONVERSATION_ENTRIES = entries_sql(lines_sql("conversations", "conv_id, turn", "text"), "conv_id, turn")
PAGE_LINES = lines_sql("pages", "page_id", "html")
PAGE_ENTRIES = entries_sql(PAGE_LINES, "page_id")


# -- counts ------------------------------------------------------------------------------
def count_sql(source: str, subject: str, patterns, rates=False) -> str:
    aggs = ", ".join(
        f"count(*) FILTER (WHERE {rx(subject, p)}) AS c{i}" for i, p in enumerate(patterns)
    )
    rows = []
    for i, p in enumerate(patterns):
        rate = f", CAST(c{i} AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 AS percentage" if rates else ""
        rows.append(f"SELECT CAST({i + 1} AS INTEGER) AS pattern_index, {lit(p)} AS pattern, c{i} AS count{rate} FROM t WHERE total > 0")
    return f"WITH src AS ({source}), t AS (SELECT count(*) AS total, {aggs} FROM src)\n" + "\nUNION ALL\n".join(rows)


def count_summary_sql(source: str, subject: str, patterns) -> str:
    aggs = " + ".join(f"count(*) FILTER (WHERE {rx(subject, p)})" for p in patterns)
    return f"WITH src AS ({source}) SELECT count(*) AS total_events_analyzed, ({aggs}) AS total_matches FROM src"


def count_report_sql(source: str, subject: str, patterns) -> str:
    """The rows of the count document: one per pattern, or one without a pattern for an empty list."""
    return f"""WITH r AS ({count_sql(source, subject, patterns)}), n AS (SELECT count(*) AS total FROM ({source}))
SELECT total AS total_events_analyzed, CAST((SELECT count(*) FROM r) AS INTEGER) AS n_patterns, r.pattern_index, r.pattern, r.count
FROM n LEFT JOIN r ON true"""


# -- funnels ---------------------------------------------------------------------------
def _mask(subject: str, conds) -> str:
    return " | ".join(f"(CASE WHEN {c} THEN {1 << i} ELSE 0 END)" for i, c in enumerate(conds))


def _progress(source: str, mask: str, order: str, k: int, limit: int = 0) -> str:
    m = f"""coalesce(list_reduce(list(mask ORDER BY {order}) FILTER (WHERE mask <> 0),
                 lambda acc, x: acc + ((x >> (acc % {k})) & 1), 0), 0)"""
    eff = "m" if limit == 0 else f"greatest(0, least(m, {max(0, limit * k)}))"
    return f"""
WITH src AS ({source}),
masked AS (SELECT *, {mask} AS mask FROM src),
prog AS (SELECT count(*) AS total, {m} AS m FROM masked),
eff AS (SELECT total, {eff} AS m FROM prog),
c AS (SELECT total, m, m // {k} AS conv, m % {k} AS rem FROM eff)"""


def _names(patterns):
    return [f"s{i + 1}_{p}" for i, p in enumerate(patterns)]


def funnel_steps_sql(progress: str, names) -> str:
    values = ", ".join(f"({i}, {lit(n)})" for i, n in enumerate(names))
    return f"""{progress},
s AS (SELECT * FROM (VALUES {values}) v(i, name)),
cnt AS (SELECT total, i, name, conv + CASE WHEN i < rem THEN 1 ELSE 0 END AS n,
               conv + CASE WHEN 0 < rem THEN 1 ELSE 0 END AS c0 FROM c, s)
SELECT CAST(i + 1 AS INTEGER) AS step_index, name, n AS event_count,
       CASE WHEN c0 > 0 THEN CAST(n AS DOUBLE) / CAST(c0 AS DOUBLE) * 100.0 ELSE 0.0 END AS percentage
FROM cnt WHERE total > 0"""


def funnel_drops_sql(progress: str, names) -> str:
    values = ", ".join(f"({i}, {lit(a)}, {lit(b)})" for i, (a, b) in enumerate(zip(names, names[1:])))
    return f"""{progress},
s AS (SELECT * FROM (VALUES {values}) v(i, f, t)),
cnt AS (SELECT total, i, f, t, conv + CASE WHEN i < rem THEN 1 ELSE 0 END AS a,
               conv + CASE WHEN i + 1 < rem THEN 1 ELSE 0 END AS b FROM c, s)
SELECT CAST(i + 1 AS INTEGER) AS step_index, f AS "from", t AS "to", a - b AS events_lost,
       CAST(a - b AS DOUBLE) / CAST(a AS DOUBLE) * 100.0 AS drop_off_rate
FROM cnt WHERE total > 0 AND a > 0"""


def funnel_summary_sql(progress: str, name: str) -> str:
    return f"""{progress}
SELECT {lit(name)} AS funnel_name, total AS total_events_analyzed, conv > 0 AS funnel_completed,
       conv AS conversions, m AS matched_events FROM c"""


def funnel_report_sql(progress: str, name: str, names) -> str:
    """The rows of the funnel document: one per step and drop-off, or one for empty lists."""
    return f"""WITH s AS ({funnel_steps_sql(progress, names)}), d AS ({funnel_drops_sql(progress, names)}),
h AS ({funnel_summary_sql(progress, name)}),
x AS (
  SELECT 'step' AS section, step_index AS idx, name, NULL AS "to", event_count AS n, percentage AS rate FROM s
  UNION ALL
  SELECT 'drop_off', CAST(row_number() OVER (ORDER BY step_index) AS INTEGER), "from", "to", events_lost, drop_off_rate FROM d
)
SELECT funnel_name, total_events_analyzed, funnel_completed, CAST((SELECT count(*) FROM s) AS INTEGER) AS n_steps,
       CAST((SELECT count(*) FROM d) AS INTEGER) AS n_drop_offs, x.*
FROM h LEFT JOIN x ON true"""


def _event_progress(patterns, limit=0):
    mask = _mask("message", [rx("message", p) for p in patterns])
    return _progress(EVENT_ENTRIES, mask, "ts, event_id", len(patterns), limit)


def _props_progress():
    conds = []
    for p, props in PROPS_FUNNEL:
        c = rx("subject", p)
        for key, pat in props.items():
            c += f" AND {rx(_prop(key), pat)}"
        conds.append(f"({c})")
    return _progress(LOGCAT_ENTRIES, _mask("subject", conds), "event_ts, event_id", len(PROPS_FUNNEL))


def _keyed_progress(patterns, limit: int = 0) -> str:
    """``_progress`` per user."""
    k = len(patterns)
    mask = _mask("message", [rx("message", p) for p in patterns])
    m = f"""coalesce(list_reduce(list(mask ORDER BY ts, event_id) FILTER (WHERE mask <> 0),
                 lambda acc, x: acc + ((x >> (acc % {k})) & 1), 0), 0)"""
    eff = "m" if limit == 0 else f"greatest(0, least(m, {max(0, limit * k)}))"
    return f"""
WITH masked AS (SELECT *, {mask} AS mask FROM (SELECT user_id, event_id, ts, coalesce(event_type, '') AS message FROM events)),
prog AS (SELECT user_id, count(*) AS total, {m} AS m FROM masked GROUP BY user_id),
c AS (SELECT user_id, total, {eff} AS m, {eff} // {k} AS conv, {eff} % {k} AS rem FROM prog)"""


def funnel_by_user_sql(patterns) -> str:
    values = ", ".join(f"({i}, {lit(n)})" for i, n in enumerate(_names(patterns)))
    return f"""{_keyed_progress(patterns)},
cnt AS (SELECT user_id, i, name, conv + CASE WHEN i < rem THEN 1 ELSE 0 END AS n, conv + CASE WHEN 0 < rem THEN 1 ELSE 0 END AS c0
        FROM c, (VALUES {values}) v(i, name))
SELECT user_id, CAST(i + 1 AS INTEGER) AS step_index, name, n AS event_count,
       CASE WHEN c0 > 0 THEN CAST(n AS DOUBLE) / CAST(c0 AS DOUBLE) * 100.0 ELSE 0.0 END AS percentage FROM cnt"""


# shapes 0 to 2 are objects, whose last "event" counts (a number in shape 1); 3 holds 1e400 and 4 is cut off, so there the message counts
PAYLOAD_REPEATED = """
WITH p AS (
  SELECT event_id, event_type, 'u' || user_id AS u, event_id % 5 AS shape FROM events
)
SELECT event_id, shape < 3 AS has_payload, CASE WHEN shape < 2 THEN u END AS "user",
       CASE WHEN shape = 1 THEN NULL WHEN shape < 3 THEN event_type ELSE coalesce(event_type, '') END AS subject FROM p
"""


# -- parsing ---------------------------------------------------------------------------------
def _int(g: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches({g}, '^[+-]?[0-9]+$') THEN TRY_CAST({g} AS BIGINT) END, 0)"


def _ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%g')"


def clock_lines_sql(broken_every: int = 0) -> str:
    clock = "strftime(ts, '%Hh%Mm%S')"
    if broken_every:
        clock = f"CASE WHEN event_id % {broken_every} = 0 THEN '99h99m99' ELSE {clock} END"
    return f"""SELECT ts AS event_ts, event_id,
  '[' || {clock} || '] ' || upper(event_type) || ' ' || event_type || ' user_' || CAST(user_id AS VARCHAR) AS value FROM events"""


def _groups(source: str, regex: str, n: int) -> str:
    gs = ", ".join(f"regexp_extract(line, {lit(regex)}, {i}) AS g{i}" for i in range(1, n + 1))
    return f"""SELECT *, {gs} FROM (SELECT *, {utrim('value')} AS line FROM ({source}))
  WHERE line <> '' AND {rx('line', regex)}"""


PARSE_THREE = f"""
WITH g AS ({_groups(clock_lines_sql(), CLOCK_REGEX, 3)}),
e AS (SELECT *, try_strptime('2000 ' || g1, '%Y %Hh%Mm%S') AS ts FROM g)
SELECT event_id, {_ts_text('ts')} AS ts, '' AS level, '' AS tag, {_int('g2')} AS pid, {_int('g3')} AS tid,
  CASE WHEN g1 <> '' AND ts IS NULL THEN g1 ELSE g3 END AS message FROM e"""

PARSE_BAD_TS = f"""
WITH g AS ({_groups(clock_lines_sql(7), LOOSE_CLOCK_REGEX, 2)}),
e AS (SELECT *, try_strptime('2000 ' || g1, '%Y %Hh%Mm%S') AS ts FROM g)
SELECT event_id, {_ts_text('ts')} AS ts, {_int('g2')} AS pid,
  CASE WHEN g1 <> '' AND ts IS NULL THEN g1 ELSE g2 END AS message FROM e"""

# the parsed clock is the event's, in the default year; the message is what follows it
PARSE_SYSLOG = """
SELECT event_id, strftime(ts, '2000-%m-%d %H:%M:%S') || '.000' AS ts, event_type || ' user_' || CAST(user_id AS VARCHAR) AS message
FROM events"""

DOC_FIELDS = f"""
WITH g AS ({_groups(DOCUMENT_LINES_CR, DOC_LINE_REGEX, 3)})
SELECT doc_id, line_no, {_int('g2')} AS pid, {_int('g3')} AS tid, g3 AS message FROM g"""

PARSE_STATS = f"""
WITH t AS (SELECT {utrim('value')} AS line FROM ({DOCUMENT_LINES_CR}))
SELECT count(*) AS total_lines,
  count(*) FILTER (WHERE line <> '' AND {rx('line', DOC_LINE_REGEX)}) AS parsed_entries,
  count(*) FILTER (WHERE line <> '' AND NOT {rx('line', DOC_LINE_REGEX)}) AS skipped_lines
FROM t"""

TABLE_PAYLOAD_ENTRIES = f"""
SELECT event_id, coalesce(event_type, '') AS message,
  CASE WHEN {_json_kind('props')} = 'OBJECT' THEN props END AS payload FROM events"""
TABLE_PAYLOAD_SUBJECT = (
    "CASE WHEN payload IS NULL OR json_type(payload, '$.event') IS NULL THEN message "
    "WHEN json_type(payload, '$.event') = 'VARCHAR' THEN json_extract_string(payload, '$.event') END"
)


def _build() -> dict[str, str]:
    o: dict[str, str] = {}
    o["count_patterns"] = count_sql(EVENT_ENTRIES, "message", EVENT_PATTERNS)
    o["count_overlapping"] = count_sql(EVENT_ENTRIES, "message", OVERLAPPING_PATTERNS)
    o["count_duplicate_patterns"] = count_sql(EVENT_ENTRIES, "message", DUPLICATE_PATTERNS)
    o["count_rates"] = count_sql(EVENT_ENTRIES, "message", EVENT_PATTERNS, rates=True)
    o["count_summary"] = count_summary_sql(EVENT_ENTRIES, "message", OVERLAPPING_PATTERNS)
    o["count_empty"] = count_sql(
        f"SELECT * FROM ({LOGCAT_LINES}) WHERE {rx(utrim('value'), '^NEVER (\\d+)$')}", "value", EVENT_PATTERNS, rates=True
    )
    o["count_payload"] = count_sql(LOGCAT_ENTRIES, "subject", PAYLOAD_PATTERNS)
    o["count_documents"] = count_sql(DOCUMENT_ENTRIES, "message", DOCUMENT_PATTERNS, rates=True)
    o["count_deep_patterns"] = count_sql(DOCUMENT_ENTRIES, "message", DEEP_PATTERNS)
    never = f"SELECT * FROM ({LOGCAT_LINES}) WHERE {rx(utrim('value'), '^NEVER (\\d+)$')}"
    o["count_ambiguous_patterns"] = count_sql(DOCUMENT_ENTRIES, "message", AMBIGUOUS_PATTERNS, rates=True)
    each = ", ".join(f"count(*) FILTER (WHERE regexp_matches(message, {lit(p)}))" for p in MANY_PATTERNS)
    names = ", ".join(lit(p) for p in MANY_PATTERNS)
    o["count_1000_patterns"] = f"""WITH src AS ({DOCUMENT_ENTRIES}), c AS (SELECT [{each}] AS n FROM src)
SELECT CAST(i AS INTEGER) AS pattern_index, [{names}][i] AS pattern, n[i] AS count FROM c, (SELECT unnest(range(1, {len(MANY_PATTERNS) + 1})) AS i)"""
    o["parse_short_fractions"] = """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g') END AS ts,
  CASE WHEN event_id % 3 = 0 THEN left(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 22) ELSE event_type END AS message FROM events"""
    o["payload_repeated_keys"] = PAYLOAD_REPEATED
    o["funnel_by_user"] = funnel_by_user_sql(MAIN_FUNNEL)
    o["funnel_by_user_summary"] = f"""{_keyed_progress(TWENTY_FUNNEL, 3)}
SELECT user_id, 'funnel' AS funnel_name, total AS total_events_analyzed, conv > 0 AS funnel_completed, conv AS conversions, m AS matched_events FROM c"""
    o["count_report"] = count_report_sql(EVENT_ENTRIES, "message", EVENT_PATTERNS)
    o["count_report_empty"] = count_report_sql(never, "value", EVENT_PATTERNS)
    o["parse_syslog_days"] = PARSE_SYSLOG
    o["table_payload_count"] = count_sql(TABLE_PAYLOAD_ENTRIES, TABLE_PAYLOAD_SUBJECT, EVENT_PATTERNS)

    main = _names(MAIN_FUNNEL)
    o["funnel_steps"] = funnel_steps_sql(_event_progress(MAIN_FUNNEL), main)
    o["funnel_drop_offs"] = funnel_drops_sql(_event_progress(MAIN_FUNNEL), main)
    o["funnel_summary"] = funnel_summary_sql(_event_progress(MAIN_FUNNEL), "funnel")
    for name, limit in LIMITS.items():
        prog = _event_progress(MAIN_FUNNEL, limit)
        if name in ("funnel_limit_1", "funnel_limit_negative"):
            o[name] = funnel_steps_sql(prog, main)
        else:
            o[name] = funnel_summary_sql(prog, "funnel")
    o["funnel_overlapping_steps"] = funnel_steps_sql(_event_progress(OVERLAP_FUNNEL), _names(OVERLAP_FUNNEL))
    o["funnel_20_steps"] = funnel_steps_sql(_event_progress(TWENTY_FUNNEL), _names(TWENTY_FUNNEL))
    o["funnel_20_drop_offs"] = funnel_drops_sql(_event_progress(TWENTY_FUNNEL), _names(TWENTY_FUNNEL))
    never = f"SELECT * FROM ({LOGCAT_LINES}) WHERE {rx(utrim('value'), '^NEVER (\\d+)$')}"
    o["funnel_empty"] = funnel_steps_sql(
        _progress(never, _mask("value", [rx("value", p) for p in MAIN_FUNNEL]), "event_ts, event_id", 3), main
    )
    o["funnel_report"] = funnel_report_sql(_event_progress(MAIN_FUNNEL), "funnel", main)
    o["funnel_report_empty"] = funnel_report_sql(
        _progress(never, _mask("value", [rx("value", p) for p in MAIN_FUNNEL]), "event_ts, event_id", 3), "funnel", main
    )
    o["funnel_required_props"] = funnel_steps_sql(_props_progress(), [f"s{i + 1}_{p}" for i, (p, _) in enumerate(PROPS_FUNNEL)])
    doc_mask = _mask("message", [rx("message", p) for p in DOCUMENT_FUNNEL])
    o["funnel_documents"] = funnel_steps_sql(
        _progress(DOCUMENT_ENTRIES, doc_mask, "doc_id, line_no", len(DOCUMENT_FUNNEL)), _names(DOCUMENT_FUNNEL)
    )
    text_mask = _mask("subject", [rx("subject", p) for p in MAIN_FUNNEL])
    o["funnel_text_log"] = funnel_steps_sql(_progress(LOGCAT_ENTRIES, text_mask, "event_ts, event_id", 3), main)

    conv_mask = _mask("message", [rx("message", p) for p in CONVERSATION_FUNNEL])
    o["funnel_conversations"] = funnel_steps_sql(
        _progress("SELECT conv_id, turn, coalesce(role, '') AS message FROM conversations", conv_mask,
                  "conv_id, turn", len(CONVERSATION_FUNNEL)),
        _names(CONVERSATION_FUNNEL),
    )
    o["count_conversation_lines"] = count_sql(CONVERSATION_ENTRIES, "message", CONVERSATION_PATTERNS, rates=True)
    o["count_page_html"] = count_sql(PAGE_ENTRIES, "message", PAGE_PATTERNS)
    o["parse_page_titles"] = f"""WITH g AS ({_groups(PAGE_LINES, PAGE_TITLE_REGEX, 1)})
SELECT page_id, line_no, g1 AS message FROM g"""
    o["text_log_scan"] = f"SELECT value FROM ({LOGCAT_LINES})"
    o["text_log_parse_stats"] = f"""WITH t AS (SELECT {utrim('value')} AS line FROM ({LOGCAT_LINES}))
SELECT count(*) AS total_lines,
  count(*) FILTER (WHERE line <> '' AND {rx('line', EVENT_LINE_REGEX)}) AS parsed_entries,
  count(*) FILTER (WHERE line <> '' AND NOT {rx('line', EVENT_LINE_REGEX)}) AS skipped_lines
FROM t"""
    o["funnel_with_parse_stats"] = f"""WITH h AS ({funnel_summary_sql(_progress(LOGCAT_ENTRIES, text_mask, "event_ts, event_id", 3), "funnel")})
SELECT * FROM h, ({o["text_log_parse_stats"]})"""
    o["parse_logcat"] = f"""WITH x AS ({LOGCAT_ENTRIES})
SELECT event_id, {_ts_text('ts')} AS ts, g4 AS level, g5 AS tag, {_int('g2')} AS pid, {_int('g3')} AS tid, message,
  payload IS NOT NULL AS has_payload, {_prop('event')} AS event, {_prop('user')} AS "user" FROM x"""
    o["parse_three_group"] = PARSE_THREE
    o["parse_bad_timestamp"] = PARSE_BAD_TS
    o["parse_whole_line"] = f"SELECT doc_id, line_no, message, '' AS level, CAST(0 AS BIGINT) AS pid FROM ({DOCUMENT_ENTRIES})"
    o["parse_document_fields"] = DOC_FIELDS
    o["parse_stats"] = PARSE_STATS
    o["nonblank_lines"] = f"SELECT doc_id, line_no, message AS line FROM ({DOCUMENT_ENTRIES})"
    o["payload_extract"] = f"""WITH x AS ({LOGCAT_ENTRIES})
SELECT event_id, payload IS NOT NULL AS has_payload, {_prop('event')} AS event, {_prop('user')} AS "user",
  CASE WHEN payload IS NULL THEN NULL ELSE json_type(payload, '$.k') IS NOT NULL END AS has_k FROM x"""
    o["match_subject"] = f"WITH x AS ({LOGCAT_ENTRIES}) SELECT event_id, subject FROM x"
    o["step_filter"] = f"WITH x AS ({LOGCAT_ENTRIES}) SELECT event_id, subject FROM x WHERE {rx('subject', 'view|click')}"
    o["required_properties"] = f"""WITH x AS ({LOGCAT_ENTRIES})
SELECT event_id FROM x WHERE {rx(_prop('user'), '^u1')} AND {rx(_prop('event'), 'v')}"""
    o["numeric_property"] = f"""WITH x AS ({TABLE_PAYLOAD_ENTRIES})
SELECT event_id, coalesce(json_type(payload, '$.k') IS NOT NULL AND payload IS NOT NULL, false) AS has_k,
  {rx(_prop('k'), '.')} AS k_matches FROM x"""
    return o


ORACLES = _build()
