"""Pattern counts: how many entries match each of N patterns.

One aggregation pass: every pattern is a ``count_if`` in the same
``agg``, so the scan is read once, each task keeps N partial counters
(map-side partial aggregation) and only N numbers per task cross the single
exchange.  The result rows are produced by exploding one struct per pattern,
in argument order; a duplicate pattern is its own row.

Searching a text for each of many patterns in turn costs N searches a row.  Beyond ``FEW``
patterns one automaton over the literals that the patterns require reads each text
once and names the patterns that can match; only these are searched, by RE2 over the batch's candidate texts.  A
pattern that is a plain literal is decided by the automaton itself.  Each task returns one number per pattern it found.
"""

from __future__ import annotations

import functools
import json
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import match_subject, matches_pattern
from ..functions.regex import translate
from ..specs import compile_patterns

# shipped by value: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["count_patterns", "count_summary", "pattern_totals", "pattern_rows", "FEW"]

FEW = 64  # patterns that one aggregation searches for one by one
_SPECIAL = set("\\.+*?()|[]{}^$")


def _automaton(literals: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for literal in literals:
        found.add_word(literal, literal)
    found.make_automaton()
    return found


def _count_task(patterns: list[tuple[str, str, bool]]):
    """Counts of a task's texts by pattern; ``patterns``: (RE2 source, required literal, the literal is the whole pattern).

    The number of entries goes under index -1."""
    by_literal: dict[str, list[int]] = {}
    for i, (_, literal, _) in enumerate(patterns):
        by_literal.setdefault(literal, []).append(i)
    always = by_literal.pop("", [])

    def run(batches):
        automaton = _automaton(by_literal) if by_literal else None
        counts, total = np.zeros(len(patterns), np.int64), 0

        def search(texts, i):
            return pc.sum(pc.match_substring_regex(texts, patterns[i][0])).as_py() or 0

        for batch in batches:
            texts = batch.column(0)
            total += len(texts)
            rows: dict[str, list[int]] = {}
            for row, text in enumerate(texts.to_pylist() if automaton else ()):
                if text:
                    for literal in {found for _, found in automaton.iter(text)}:
                        rows.setdefault(literal, []).append(row)
            for literal, at in rows.items():
                candidates = None
                for i in by_literal[literal]:
                    if patterns[i][2]:
                        counts[i] += len(at)
                        continue
                    if candidates is None:
                        candidates = texts.take(pa.array(at))
                    counts[i] += search(candidates, i)
            for i in always:
                counts[i] += search(texts, i)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int32()), pa.array([total, *counts[found].tolist()], pa.int64())], names=["i", "n"])

    return run


def _many_totals(subject: DataFrame, patterns: Sequence[str]) -> DataFrame:
    specs = []
    for p in patterns:
        rx = translate(p)
        specs.append((rx.named, rx.required, rx.required == p and not _SPECIAL & set(p)))
    found = subject.mapInArrow(_count_task(specs), "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n"))
    one = found.agg(  # at most a row per pattern
        F.coalesce(F.sum(F.when(F.col("i") < 0, F.col("n"))), F.lit(0).cast("bigint")).alias("total_events_analyzed"),
        F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("_found"),
    )
    each = F.transform(F.sequence(F.lit(0), F.lit(len(patterns) - 1)), lambda i: F.coalesce(F.element_at("_found", i), F.lit(0).cast("bigint")))
    return one.select("total_events_analyzed", each.alias("counts"))


@functools.cache
def _subject() -> Column:
    return match_subject(F.col("message"), F.col("event_data")).alias("_subject")


def pattern_totals(entries: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """One row: ``total_events_analyzed BIGINT`` and ``counts ARRAY<BIGINT>`` (matches per pattern)."""
    compile_patterns(patterns)  # an invalid pattern fails the whole count up front
    subject = entries.select(_subject())
    # RE2 as pyarrow has it tests \B inside characters too, so such a pattern keeps a count to the one-by-one form
    if len(patterns) > FEW and not any("\\B" in p for p in patterns):
        return _many_totals(subject, patterns)
    totals, counts = _few_totals(tuple(patterns))
    return subject.agg(*totals).select("total_events_analyzed", counts)


@functools.lru_cache(maxsize=64)  # the same expressions for the same patterns, some hundred calls to build
def _few_totals(patterns: tuple[str, ...]) -> tuple[list[Column], Column]:
    totals = [F.count(F.lit(1)).alias("total_events_analyzed")]
    totals += [F.count_if(matches_pattern(F.col("_subject"), p)).alias(f"c{i}") for i, p in enumerate(patterns)]
    return totals, F.array(*[F.col(f"c{i}") for i in range(len(patterns))]).cast("array<bigint>").alias("counts")


@functools.lru_cache(maxsize=64)
def _listed(patterns: tuple[str, ...]) -> Column:
    return F.from_json(F.lit(json.dumps(patterns)), "array<string>")


def pattern_rows(patterns: Sequence[str]) -> Column:
    """``ARRAY<STRUCT<pattern, count>>`` over ``pattern_totals``, in argument order."""
    if not patterns:
        return F.array().cast("array<struct<pattern:string,count:bigint>>")
    return F.zip_with(_listed(tuple(patterns)), F.col("counts"), lambda p, n: F.struct(p.alias("pattern"), n.alias("count")))


def count_patterns(entries: DataFrame, patterns: Sequence[str], *, with_rates: bool = False) -> DataFrame:
    """``DataFrame[pattern_index INT, pattern STRING, count BIGINT (, percentage DOUBLE)]``.

    ``pattern_index`` is 1-based argument order.  No entries → no rows.
    ``percentage`` is ``count / total * 100``.
    """
    patterns = list(patterns)
    totals = pattern_totals(entries, patterns)
    exploded = totals.filter(F.col("total_events_analyzed") > 0).select(
        "total_events_analyzed", F.posexplode(pattern_rows(patterns)).alias("_i", "_r")
    )
    cols = [
        (F.col("_i") + 1).cast("int").alias("pattern_index"),
        F.col("_r.pattern").alias("pattern"),
        F.col("_r.count").alias("count"),
    ]
    if with_rates:
        cols.append((F.col("_r.count") / F.col("total_events_analyzed") * 100.0).alias("percentage"))
    return exploded.select(*cols)


def count_summary(entries: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """One row: ``total_events_analyzed``, ``total_matches`` (sum over patterns;
    an entry matching two patterns counts twice)."""
    matches = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    return pattern_totals(entries, list(patterns)).select("total_events_analyzed", matches.alias("total_matches"))
