"""Line → entry: one pass of column expressions over the lines.

Positional capture groups of the line regex fill the entry (1 timestamp,
2 pid, 3 tid, 4 level, 5 tag, 6 message); the message falls back to an
unparsable timestamp text, then to the last group.  With JSON extraction on,
the payload is the JSON object found by the payload regex on the raw line, or
else the message itself when that is a JSON object.

The work is staged in a few ``select``s so each expensive expression (the line
regex, the JSON decode) is evaluated once per line; Catalyst keeps the stages
apart because their outputs are used more than once, and prunes every field a
downstream query does not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.payload import null_payload, parse_parts, payload_of, plain_json
from ..functions.regex import JavaRegex, extract_group, extract_groups, first_match_groups_pattern, search
from ..functions.text import unicode_trim
from ..specs import ParserSpec, TimeLayout, pattern_guard

__all__ = ["parse_entries", "parse_stats", "ENTRY_COLUMNS"]

ENTRY_COLUMNS = ("ts", "level", "tag", "pid", "tid", "message", "event_data")

# Fixed value: separator used to return all capture groups of one match as one string.
_SEP = "\u001f"
_INT_TEXT = "\\A[+-]?[0-9]+\\z"


def barrier(df: DataFrame, carry, **exprs: Column) -> DataFrame:
    """Evaluate ``exprs`` once per row and expose them as new columns.

    The columns are produced by a one-element ``inline`` generator, which the
    optimizer neither inlines into consumers nor lets predicates pass, so a
    filter written on top of the result cannot re-evaluate (and multiply) an
    expensive expression such as a regex or a JSON decode.
    """
    return df.select(*carry, F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def _groups_stage(df: DataFrame, text: str, rx: JavaRegex, prefix: str, carry) -> tuple[DataFrame, list[str]]:
    """Add columns ``{prefix}1..n``: the groups of the leftmost match of ``rx`` in ``text``.

    Rows must match.  With two or more groups, one ``regexp_replace`` returns
    all groups joined by a separator and ``split`` cuts them apart; a row whose
    groups contain the separator itself falls back to per-group extraction.
    """
    n = rx.groups
    names = [f"{prefix}{i}" for i in range(1, n + 1)]
    if n == 0:
        return df, names
    if not rx.java:
        staged = df.select(*carry, extract_groups(F.col(text), rx).alias("_parts"))
        return staged.select(*carry, *[F.get(F.col("_parts"), i).alias(name) for i, name in enumerate(names)]), names
    if n == 1:
        return barrier(df, carry, **{names[0]: F.regexp_extract(F.col(text), rx.pattern, 1)}), names
    joined, groups = _all_groups(text, rx, tuple(names))
    return barrier(df, [*carry, F.col(text)], _parts=joined).select(*carry, *groups), names


# Expressions over columns of fixed names are the same for every call and take hundreds of calls to build, so they are kept.
@functools.lru_cache(maxsize=256)
def _all_groups(text: str, rx: JavaRegex, names: tuple[str, ...]) -> tuple[Column, list[Column]]:
    n = len(names)
    repl = "".join(_SEP + f"${i}" for i in range(1, n + 1))
    joined = F.split(F.regexp_replace(F.col(text), first_match_groups_pattern(rx), repl), _SEP)
    ok = F.size("_parts") == n + 1
    return joined, [
        F.when(ok, F.get(F.col("_parts"), i)).otherwise(F.regexp_extract(F.col(text), rx.pattern, i)).alias(name) for i, name in enumerate(names, 1)
    ]


def _has_year(fmt: str) -> bool:
    quoted = False
    for ch in fmt:
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "yuY":
            return True
    return False


def _timestamp_parts(g1: Column, spec: ParserSpec) -> tuple[Column, Column]:
    """(parsed_ok, ts) for the timestamp text ``g1`` under ``spec``."""
    fmt, value, shaped = str(spec.timestamp_format), g1, F.lit(True)
    if isinstance(spec.timestamp_format, TimeLayout):
        shaped, value = spec.timestamp_format.text(g1)
    elif guard := pattern_guard(fmt):
        shaped = F.coalesce(g1.rlike(guard), F.lit(False))
    if not _has_year(fmt):
        # year-less formats: parse inside a leap year so Feb 29 is valid
        value = F.concat(F.lit(f"{spec.default_year:04d} "), value)
        fmt = "yyyy " + fmt
    ok = shaped & F.coalesce(F.try_to_timestamp(value, F.lit(fmt)).isNotNull(), F.lit(False))
    return ok, F.when(ok, F.to_timestamp_ntz(value, F.lit(fmt)))


def _safe_int(g: Column) -> Column:
    return F.coalesce(F.when(g.rlike(_INT_TEXT), g.try_cast("bigint")), F.lit(0).cast("bigint"))


def _lines(lines: DataFrame, spec: ParserSpec, line_col: str, keep):
    rx = spec.line_regex
    carry = [F.col(c) for c in keep]
    raw, trimmed, parsed = _line_exprs(line_col, rx)
    return lines.select(*carry, raw, trimmed), rx, parsed


@functools.lru_cache(maxsize=256)
def _line_exprs(line_col: str, rx: JavaRegex) -> tuple[Column, Column, Column]:
    line = F.col(line_col)
    return line.alias("_raw"), unicode_trim(line).alias("_line"), (F.col("_line") != "") & search(F.col("_line"), rx)


def _observed(staged: DataFrame, parsed: Column, stats: Observation, keep) -> DataFrame:
    """The parsed lines of ``staged``; ``stats`` counts on the way."""
    nonblank = F.col("_line") != ""
    tested = barrier(staged, [*[F.col(c) for c in keep], F.col("_raw"), F.col("_line")], _parsed=F.coalesce(parsed, F.lit(False)))
    tested = tested.observe(
        stats,
        F.count(F.lit(1)).alias("total_lines"), F.count_if("_parsed").alias("parsed_entries"), F.count_if(nonblank & ~F.col("_parsed")).alias("skipped_lines"),
    )
    return tested.filter("_parsed").drop("_parsed")


def parse_entries(
    lines: DataFrame, spec: ParserSpec = ParserSpec(), *, line_col: str = "value", keep=None, stats: Observation | None = None
) -> DataFrame:
    """Parse text lines into ``DataFrame[*keep, ts, level, tag, pid, tid, message, event_data]``.

    Blank lines and lines the line regex does not match are dropped.  ``keep``
    (default: every column except ``line_col``) is carried along, e.g. the
    order columns of a text source.  ``stats`` receives the counters of ``parse_stats`` from the pass that first
    reads the entries (a count, a funnel), without a scan of its own; read them with ``stats.get``.
    """
    if keep is None:
        keep = [c for c in lines.columns if c != line_col]
    keep = list(keep)
    staged, rx, parsed = _lines(lines, spec, line_col, keep)
    staged = staged.filter(parsed) if stats is None else _observed(staged, parsed, stats, keep)
    carry = [F.col(c) for c in keep] + [F.col("_raw")]
    groups, g = _groups_stage(staged, "_line", rx, "_g", carry)
    message, fields = _field_exprs(spec, getattr(spec.timestamp_format, "guard", None), tuple(g))
    # message feeds the payload fallback and every match, so it is materialized once
    with_msg = barrier(groups, [*carry, *[F.col(x) for x in g]], message=message)
    fields = with_msg.select(*carry, *fields, F.col("message"))
    base = [F.col(c) for c in keep] + [F.col(c) for c in ENTRY_COLUMNS[:-1]]
    if not spec.json_extraction:
        out = fields.select(*base, null_payload().alias("event_data"))
    else:
        out = with_payload(fields, base, F.col("_raw"), spec)
    return out


@functools.lru_cache(maxsize=256)
def _field_exprs(spec: ParserSpec, guard: str | None, names: tuple[str, ...]) -> tuple[Column, list[Column]]:
    """The message, and ts, level, tag, pid and tid, from the group columns ``names`` (``guard`` tells layouts of equal text apart)."""
    n = len(names)
    col = {i: F.col(name) for i, name in enumerate(names, 1)}
    empty = F.lit("")
    ts = F.lit(None).cast("timestamp_ntz")
    ts_failed = F.lit(False)
    if spec.timestamp_format and n >= 1:
        ok, ts = _timestamp_parts(col[1], spec)
        ts_failed = (col[1] != "") & ~ok
    if n == 0:
        message = empty
    else:
        message = F.when(ts_failed, col[1]).otherwise(col[n])
        if n >= 6:
            message = F.when(col[6] != "", col[6]).otherwise(message)
    return message, [
        ts.alias("ts"),
        (col[4] if n >= 4 else empty).alias("level"),
        (col[5] if n >= 5 else empty).alias("tag"),
        (_safe_int(col[2]) if n >= 2 else F.lit(0).cast("bigint")).alias("pid"),
        (_safe_int(col[3]) if n >= 3 else F.lit(0).cast("bigint")).alias("tid"),
    ]


def with_payload(df: DataFrame, base, raw: Column, spec: ParserSpec) -> DataFrame:
    """Add ``event_data``: the payload regex's group 1 on the raw line when that is
    a JSON object (or ``null``), else the message when that is one, else NULL.

    Staged so each JSON text is parsed once per line."""
    ev = spec.payload_regex
    msg = F.col("message")
    if ev.groups >= 1:
        found = F.coalesce(search(raw, ev), F.lit(False))
        df = df.select("*", F.when(found, unicode_trim(extract_group(raw, ev, 1))).alias("_found"))
        cand = F.col("_found")
    else:
        cand = F.lit(None).cast("string")
    staged = barrier(df, base, _cand=cand)
    candidate, message, payload = _payload_stages()
    parsed = barrier(staged, [*base, F.col("_cand")], **candidate)
    # the message is parsed only for lines whose candidate is not a plain JSON object
    parsed = barrier(parsed, [*base, F.col("_cand"), F.col("_c_el")], **message)
    # a projection of its own: lambdas keep a generator from being compiled, but not a projection
    return barrier(parsed.select(*base, payload.alias("_payload")), base, event_data=F.col("_payload"))


@functools.cache  # the same expressions for every parse, some hundred calls to build
def _payload_stages() -> tuple[dict[str, Column], dict[str, Column], Column]:
    """The parses of the candidate and of the message, and the payload from both."""
    cand, msg = F.col("_cand"), F.col("message")
    elements, closed = parse_parts(cand)
    c_plain = plain_json(cand, F.col("_c_el"), F.col("_c_closed"))
    m_elements, m_closed = parse_parts(msg)
    of_message = payload_of(msg, F.col("_m_el"), plain_json(msg, F.col("_m_el"), F.col("_m_closed")))
    of_found = payload_of(cand, F.col("_c_el"), F.col("_c_plain"))
    payload = F.when(F.col("_c_plain"), of_found).otherwise(F.coalesce(of_found, of_message))
    message = {"_c_plain": c_plain, "_m_el": F.when(~c_plain, m_elements), "_m_closed": F.when(~c_plain, m_closed)}
    return {"_c_el": elements, "_c_closed": closed}, message, payload


def parse_stats(lines: DataFrame, spec: ParserSpec = ParserSpec(), *, line_col: str = "value") -> DataFrame:
    """One row: ``total_lines``, ``parsed_entries``, ``skipped_lines`` (lines the
    line regex rejects; blank lines are counted in the total only)."""
    staged, rx, parsed = _lines(lines, spec, line_col, [])
    nonblank = F.col("_line") != ""
    return staged.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(parsed).alias("parsed_entries"),
        F.count_if(nonblank & ~parsed).alias("skipped_lines"),
    )
