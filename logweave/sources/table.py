"""Entries and lines from tables that are already in Spark."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import null_payload, parse_parts, payload_of, plain_json
from ..functions.text import strip_one_cr

__all__ = ["entries_from_table", "lines_from_text_column", "ENTRY_COLUMNS"]

ENTRY_COLUMNS = ("ts", "level", "tag", "pid", "tid", "message", "event_data")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entries_from_table(
    df: DataFrame,
    *,
    message,
    payload=None,
    payload_json=None,
    ts=None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project any table onto the entry schema.

    ``message`` is the text patterns match when there is no payload event;
    ``payload`` is a ``map<string,variant>`` column, or ``payload_json`` a JSON
    text column decoded strictly (anything but an object gives no payload);
    ``keep`` carries extra columns along, e.g. the order columns of a funnel.
    """
    if payload is not None and payload_json is not None:
        raise ValueError("give payload or payload_json, not both")
    clash = [c for c in keep if c in ENTRY_COLUMNS]
    if clash:
        raise ValueError(f"keep columns {clash} clash with entry columns; pass ts= to use a table column as ts")
    fields = [
        *[F.col(c) for c in keep],
        (_col(ts).cast("timestamp_ntz") if ts is not None else F.lit(None).cast("timestamp_ntz")).alias("ts"),
        F.lit("").alias("level"),
        F.lit("").alias("tag"),
        F.lit(0).cast("bigint").alias("pid"),
        F.lit(0).cast("bigint").alias("tid"),
        F.coalesce(_col(message).cast("string"), F.lit("")).alias("message"),
    ]
    if payload_json is None:
        ev = _col(payload) if payload is not None else null_payload()
        return df.select(*fields, ev.alias("event_data"))
    # decode each JSON text once, behind a generator that filters cannot see through
    from ..operators.parse import barrier

    names = [c for c in keep] + ["ts", "level", "tag", "pid", "tid", "message"]
    text = df.select(*fields, _col(payload_json).cast("string").alias("_json"))
    parts, payload_expr = _payload_stages()
    parsed = barrier(text, [*[F.col(c) for c in names], F.col("_json")], **parts)
    whole = parsed.select(*[F.col(c) for c in names], payload_expr.alias("_payload"))
    return barrier(whole, [F.col(c) for c in names], event_data=F.col("_payload"))


@functools.cache
def _payload_stages() -> tuple[dict[str, Column], Column]:
    json = F.col("_json")
    elements, closed = parse_parts(json)
    return {"_el": elements, "_closed": closed}, payload_of(json, F.col("_el"), plain_json(json, F.col("_el"), F.col("_closed")))


def lines_from_text_column(df: DataFrame, text, keep: Sequence[str] = ()) -> DataFrame:
    """Split a text column into lines: ``DataFrame[*keep, line_no INT, value STRING]``.

    Line breaks are ``\\n``; one trailing ``\\r`` per line is dropped and a
    final empty piece after a trailing newline is not a line (an empty text has
    no lines), as a line scanner reads a file.  ``keep`` plus ``line_no`` is the
    line order.
    """
    parts = F.split(_col(text), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    exploded = df.select(*[F.col(c) for c in keep], F.posexplode(parts).alias("line_no", "value"))
    return exploded.select(*[F.col(c) for c in keep], "line_no", strip_one_cr(F.col("value")).alias("value"))
