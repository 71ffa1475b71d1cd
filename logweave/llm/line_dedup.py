"""Line de-duplication over overlapping three-line windows [native].

Every three consecutive lines of a document are hashed to 128 bits.  A window
seen before, in (doc_id, line) order over the whole table, is a repeat; the lines
its later occurrences cover are removed, overlapping and touching occurrences
being merged into one run.  The first occurrence stays whole unless another
window's repeat covers part of it.

Shuffles: one row of numbers per window, pre-aggregated per hash before it
moves, and the texts once, to meet the positions to remove.  A hot window has
one pre-aggregated row per task in the first; the first occurrences are then
written, so that the second is a join of two plain shuffles, which adaptive execution splits where one
window has too many rows.  Nothing is gathered per window, and the
positions of a document are bounded by its own lines.

Defined results: a null text stays null, with 0 lines; texts of fewer than
``window`` lines have no windows and stay; windows without a word are ignored;
null ids sort last; rows with equal doc_id and text are one document and
are cut alike; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_hash

__all__ = ["window_rows", "later_windows", "dedup_lines"]


def _windows(lines: Column, window: int) -> Column:
    """Array of 128-bit hashes, one per window; null where a window has no word."""

    def hashed(i):
        parts = [lines[i + k] for k in range(window)]
        has_word = F.lit(False)
        for p in parts:
            has_word = has_word | (F.length(F.trim(F.translate(p, "\t\x0b\x0c\r", "    "))) > 0)
        return F.when(
            has_word, F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("h2"))
        )

    n = F.size(lines)
    return F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), hashed))


def window_rows(docs: DataFrame, window: int = 3) -> DataFrame:
    """``doc_id, th, pos, h1, h2``: one row per window of ``docs[doc_id, text]``."""
    lines = docs.filter(F.col("text").isNotNull()).select(
        "doc_id", text_hash(F.col("text")).alias("th"), F.split("text", "\n", -1).alias("_l")
    )
    rows = lines.select("doc_id", "th", F.posexplode(_windows(F.col("_l"), window)).alias("pos", "_h"))
    return rows.filter(F.col("_h").isNotNull()).select("doc_id", "th", "pos", "_h.h1", "_h.h2")


def later_windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """``doc_id, th, positions``: per document the sorted starts of windows seen before it."""
    rows = window_rows(docs, window)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"), F.col("pos"))
    firsts = rows.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = firsts.filter("_n > 1").select(F.col("h1").alias("_a"), F.col("h2").alias("_b"), "_first")
    firsts = Scratch(docs.sparkSession, "lines").save(firsts, "firsts")
    later = rows.join(firsts, (F.col("h1") == F.col("_a")) & (F.col("h2") == F.col("_b")))
    later = later.filter(~place.eqNullSafe(F.col("_first")))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("positions"))


def _kept(lines: Column, positions: Column, window: int) -> Column:
    """``lines`` without the runs that ``positions`` (sorted window starts) cover.

    Linear work if ``lines`` is a value that is there already (a column or a lambda variable): inside a lambda an expression is evaluated
    for every element, and ``slice`` copies its whole input, so the lines left are fetched one by one by their index."""
    starts = F.filter(positions, lambda p, i: (i == 0) | (p > positions[F.greatest(i - 1, F.lit(0))] + window))
    ends = F.transform(
        F.filter(positions, lambda p, i: (i == F.size(positions) - 1) | (positions[F.least(i + 1, F.size(positions) - 1)] > p + window)),
        lambda p: p + window,
    )
    # kept line ranges: before the first run, between runs, after the last
    lows = F.concat(F.array(F.lit(0)), ends)
    highs = F.concat(starts, F.array(F.size(lines)))
    left = F.flatten(F.zip_with(lows, highs, lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))))
    return F.transform(left, lambda i: F.get(lines, i))


def dedup_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """``docs`` with ``text`` cut, plus ``n_lines BIGINT`` (before) and ``n_removed BIGINT``."""
    names = docs.columns
    later = later_windows(docs.select("doc_id", "text"), window).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("positions").alias("_pos")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    rows = rows.withColumn("_key", F.col("_doc.doc_id")).withColumn("_hash", text_hash(F.col("_doc.text")))
    met = rows.join(later.hint("merge"), F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")), "left")
    lines = F.split(F.col("_doc.text"), "\n", -1)
    n = F.when(F.col("_doc.text").isNotNull(), F.size(lines)).otherwise(0)
    # the lines are bound to a lambda variable, so a text that is cut is split once, not once per line; a one-element generator
    # (of two in a row Spark loses columns when it prunes the fields of _doc) cuts them once for both columns
    left = F.get(F.transform(F.array(lines), lambda x: _kept(x, F.col("_pos"), window)), F.lit(0))
    cut = met.select("_doc", n.alias("_n"), F.explode(F.array(F.when(F.col("_pos").isNotNull(), left))).alias("_left"))
    new = {"text": F.coalesce(F.array_join("_left", "\n"), F.col("_doc.text"))}
    return cut.select(
        *[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in names if c not in ("n_lines", "n_removed")],
        F.col("_n").cast("bigint").alias("n_lines"),
        F.when(F.col("_left").isNotNull(), F.col("_n") - F.size("_left")).otherwise(0).cast("bigint").alias("n_removed"),
    )
