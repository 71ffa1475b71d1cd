"""Text helpers shared by the sources and the line parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["WHITE_SPACE", "unicode_trim", "strip_one_cr"]

# The Unicode White_Space code points, the set a Unicode
# "trim space" removes: U+0009..U+000D, U+0020, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WHITE_SPACE = (
    "".join(chr(c) for c in range(0x09, 0x0E))
    + "\u0020\u0085\u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def unicode_trim(col: Column) -> Column:
    """Remove leading and trailing Unicode white space (plain ``trim`` strips spaces only)."""
    return F.trim(col, F.lit(WHITE_SPACE))


def strip_one_cr(col: Column) -> Column:
    """Drop one carriage return at the end of a line, as line scanners do for CRLF files."""
    # only lines that end in CR pay for the rewrite
    return F.when(col.endswith("\r"), F.regexp_replace(col, "\\r\\z", "")).otherwise(col)
