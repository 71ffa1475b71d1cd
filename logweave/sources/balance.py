"""Spreading coarse inputs over the cluster's cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["spread"]


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over ``partitions`` tasks; without a number, ``df`` as it is.

    For the caller who knows that a table is stored in too few row groups for the CPU-heavy
    per-row work that follows.  Every column of ``df`` crosses the shuffle, so
    select the needed ones first.  Only for row sources whose order lives in
    columns: a text log's line order is physical and must not be shuffled.

    The spread rows pass a one-to-one generator, so predicates written later
    (a line-format regex, say) run after the shuffle on all cores instead of
    being pushed back into the coarse scan.
    """
    if partitions is None:
        return df
    # round-robin, not a hash of the content: repeated rows (copied lines) would
    # all hash to one task
    spread_rows = df.repartition(partitions)
    return spread_rows.select(F.inline(F.array(F.struct(*[F.col(c) for c in spread_rows.columns]))))
