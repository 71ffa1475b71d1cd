"""Log lines derived from the ``events`` table, so that parsing, payload
extraction and text-log funnels run over data that grows with the tables.

Each event becomes one line of a layout of our own::

    MM/dd HH:mm:ss.SSS [<user_id>:<event_id>] <I|E> metrics - <payload>

with the payload shape chosen by ``event_id % 6``: a JSON object with a string
``event``, one with a numeric ``event``, one with a JSON-null ``event``, the
row's ``props`` object (no ``event`` key), plain text, and the JSON literal
``null``.  The same formula is written in SQL for the oracle.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import wall_clock_text

__all__ = [
    "EVENT_LINE_REGEX", "EVENT_LINE_FORMAT", "PAYLOAD_REGEX", "logcat_lines", "repeated_key_payload", "clock_lines", "fraction_lines", "syslog_lines",
    "write_lines",
]

# The line layout above (RE2), its timestamp format and payload locator.
EVENT_LINE_REGEX = r"^(\d\d/\d\d \d\d:\d\d:\d\d\.\d{3}) \[(\d+):(\d+)\] ([A-Z]) (\w+) - (.*)$"
EVENT_LINE_FORMAT = "MM/dd HH:mm:ss.SSS"
PAYLOAD_REGEX = r"metrics - (.*)$"


def _s(c) -> F.Column:
    return F.col(c).cast("string")


def logcat_lines(events: DataFrame) -> DataFrame:
    """``DataFrame[ts, event_id, value]``: one line per event."""
    return events.select("ts", "event_id", _logcat_line())


@functools.cache
def _logcat_line():
    shape = F.col("event_id") % 6
    payload = (
        F.when(shape == 0, F.concat(F.lit('{"event": "'), _s("event_type"), F.lit('", "user": "u'), _s("user_id"), F.lit('"}')))
        .when(shape == 1, F.concat(F.lit('{"event": '), _s("user_id"), F.lit(', "type": "'), _s("event_type"), F.lit('"}')))
        .when(shape == 2, F.concat(F.lit('{"event": null, "user": "u'), _s("user_id"), F.lit('"}')))
        .when(shape == 3, F.coalesce(F.col("props"), F.lit("{}")))
        .when(shape == 4, F.concat(_s("event_type"), F.lit(" by user_"), _s("user_id")))
        .otherwise(F.lit("null"))
    )
    level = F.when(F.col("event_type") == "error", F.lit("E")).otherwise(F.lit("I"))
    line = F.concat(
        wall_clock_text("ts", EVENT_LINE_FORMAT), F.lit(" ["), _s("user_id"), F.lit(":"), _s("event_id"),
        F.lit("] "), level, F.lit(" metrics - "), payload,
    )
    return line.alias("value")


def repeated_key_payload():
    """A JSON text of an event's type and user that repeats a key, by ``event_id % 5``."""
    kind, user, shape = _s("event_type"), _s("user_id"), F.col("event_id") % 5
    return (
        F.when(shape == 0, F.concat(F.lit('{"event":"old","user":"u'), user, F.lit('","event":"'), kind, F.lit('"}')))
        .when(shape == 1, F.concat(F.lit('{"event":"'), kind, F.lit('","user":"u'), user, F.lit('","event":'), user, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"n":{"x":1,"x":[2]},"event" : "'), kind, F.lit('"}')))
        .when(shape == 3, F.concat(F.lit('{"event":"lost","user":"u'), user, F.lit('","k":1e400}')))
        .otherwise(F.concat(F.lit('{"event":"'), kind, F.lit('","event":"x"')))
    )


def clock_lines(events: DataFrame, *, broken_every: int = 0) -> DataFrame:
    """``DataFrame[ts, event_id, value]``: ``[HHhMMmSS] LEVEL text`` lines (three fields).

    With ``broken_every = n``, every n-th event id carries an unparsable clock text."""
    clock = F.concat_ws("", wall_clock_text("ts", "HH"), F.lit("h"), wall_clock_text("ts", "mm"), F.lit("m"), wall_clock_text("ts", "ss"))
    if broken_every:
        clock = F.when(F.col("event_id") % broken_every == 0, F.lit("99h99m99")).otherwise(clock)
    line = F.concat(F.lit("["), clock, F.lit("] "), F.upper(_s("event_type")), F.lit(" "), _s("event_type"),
                    F.lit(" user_"), _s("user_id"))
    return events.select("ts", "event_id", line.alias("value"))


def fraction_lines(events: DataFrame) -> DataFrame:
    """``DataFrame[ts, event_id, value]``: ``{ISO clock} text`` lines; every third clock lacks the last digit of its fraction."""
    clock = F.concat(wall_clock_text("ts", "yyyy-MM-dd"), F.lit("T"), wall_clock_text("ts", "HH:mm:ss.SSS"))
    clock = F.when(F.col("event_id") % 3 == 0, F.substring(clock, 1, 22)).otherwise(clock)
    return events.select("ts", "event_id", F.concat(F.lit("{"), clock, F.lit("} "), _s("event_type")).alias("value"))


def syslog_lines(events: DataFrame) -> DataFrame:
    """``DataFrame[ts, event_id, value]``: ``Mon _d H:mm:ss text`` lines, days 1-9 padded with a space, hours not padded."""
    months = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    line = F.concat(
        F.element_at(months, F.month("ts")), F.lit(" "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.lit(" "),
        F.hour("ts").cast("string"), F.lit(":"), wall_clock_text("ts", "mm"), F.lit(":"), wall_clock_text("ts", "ss"), F.lit(" "), _s("event_type"), F.lit(" user_"), _s("user_id"),
    )
    return events.select("ts", "event_id", line.alias("value"))


def write_lines(lines: DataFrame, path: str, order_by=("ts", "event_id")) -> str:
    """Write ``value`` as text files whose path order is ``order_by`` order.

    Range partitioning gives each part file a contiguous key range and part
    numbers follow the ranges, so reading the folder back in path and line
    order reproduces ``order_by``."""
    cols = [F.col(c) for c in order_by]
    lines.repartitionByRange(*cols).sortWithinPartitions(*cols).select("value").write.mode("overwrite").text(path)
    return path
