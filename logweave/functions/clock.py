"""Wall-clock text of TIMESTAMP_NTZ values, independent of the session time zone.

``date_format`` on a TIMESTAMP_NTZ value goes through the session zone (an
implicit cast to TIMESTAMP), which moves wall-clock times that fall into a
daylight-saving gap.  The plain string cast of a TIMESTAMP_NTZ value does not
(``yyyy-MM-dd HH:mm:ss[.ffffff]``), so the text is cut from it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["wall_clock_text"]

# field -> (start, length) in the cast text "yyyy-MM-dd HH:mm:ss.ffffff" (years 1..9999)
_FIELDS = {"yyyy": (1, 4), "MM": (6, 2), "dd": (9, 2), "HH": (12, 2), "mm": (15, 2), "ss": (18, 2)}
_TOKEN = re.compile("yyyy|MM|dd|HH|mm|ss|SSS")


def wall_clock_text(col: Column | str, pattern: str) -> Column:
    """Format a TIMESTAMP_NTZ column with the letters yyyy MM dd HH mm ss SSS (the
    fraction is truncated, as ``SSS`` does); other characters are literal."""
    c = F.col(col) if isinstance(col, str) else col
    text = c.cast("timestamp_ntz").cast("string")
    parts, pos = [], 0
    for m in _TOKEN.finditer(pattern):
        if m.start() > pos:
            parts.append(F.lit(pattern[pos : m.start()]))
        if m.group() == "SSS":
            # the cast drops a zero fraction and trailing zeros: pad back to 3 digits
            parts.append(F.rpad(F.substring(text, 21, 3), 3, "0"))
        else:
            start, length = _FIELDS[m.group()]
            parts.append(F.substring(text, start, length))
        pos = m.end()
    if pos < len(pattern):
        parts.append(F.lit(pattern[pos:]))
    return F.concat(*parts)
