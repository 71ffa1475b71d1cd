"""JSON result documents (one row, one string), like the tool's JSON output.

Each document is a projection of the one-row result, so nothing is computed twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.count import pattern_rows, pattern_totals
from ..operators.funnel import FunnelResult

__all__ = ["count_report", "funnel_report"]


def count_report(entries: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """One row ``report STRING``: ``{"total_events_analyzed": n, "pattern_counts": [{"pattern", "count"}...]}``.

    No entries give an empty list."""
    patterns = list(patterns)
    totals = pattern_totals(entries, patterns)
    kind = "array<struct<pattern:string,count:bigint>>"
    listed = F.when(F.col("total_events_analyzed") > 0, pattern_rows(patterns).cast(kind)).otherwise(F.array().cast(kind))
    return totals.select(F.to_json(F.struct("total_events_analyzed", listed.alias("pattern_counts"))).alias("report"))


def funnel_report(result: FunnelResult) -> DataFrame:
    """One row ``report STRING``: the funnel summary with its ``steps`` and ``drop_offs`` lists."""
    steps = F.transform(result.step_array(), lambda s: F.struct(s["name"], s["event_count"], s["percentage"]))
    drops = F.transform(result.drop_array(), lambda s: F.struct(s["from"], s["to"], s["events_lost"], s["drop_off_rate"]))
    doc = F.struct(
        F.lit(result.spec.name).alias("funnel_name"), "total_events_analyzed", (F.col("conversions") > 0).alias("funnel_completed"),
        steps.cast("array<struct<name:string,event_count:bigint,percentage:double>>").alias("steps"),
        drops.cast("array<struct<`from`:string,`to`:string,events_lost:bigint,drop_off_rate:double>>").alias("drop_offs"),
    )
    return result._counts().select(F.to_json(doc).alias("report"))
