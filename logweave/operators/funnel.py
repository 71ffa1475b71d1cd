"""Ordered multi-step funnels: step counts, conversion rates, drop-offs.

Every match advances the funnel by exactly one step, so the whole result is a
function of M, the number of matches of the walk (``fold.py`` computes it in
parallel).  With k steps::

    count[i]    = M div k + (1 if i < M mod k else 0)
    conversions = M div k            completed = conversions > 0

A conversion limit L != 0 stops the walk at the L-th completion, when every
step count is exactly L, hence M_L = max(0, min(M, L*k)); a negative limit
stops before the first entry.  All reported tables are projections of the
one-row progress ``(total_events_analyzed, matches)``.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import match_subject, matches_step
from ..specs import FunnelSpec, Step
from ..session import Scratch
from .fold import fold_runs, mask_words, walk, walk_by

__all__ = [
    "funnel_progress",
    "FunnelResult",
    "analyze_funnel",
    "funnel_steps",
    "funnel_drop_offs",
    "funnel_summary",
    "step_mask_columns",
]

_LONG_MAX = (1 << 63) - 1


def step_mask_columns(entries: DataFrame, spec: FunnelSpec, keep: Sequence[str]) -> tuple[DataFrame, list[str], list[int]]:
    """``entries`` reduced to ``keep`` plus packed match bits ``_m0..``; the names of these, and the bit of each step.

    Steps with the same pattern and properties share a bit."""
    asked = tuple((s.event_pattern, tuple(sorted(s.required_properties.items()))) for s in spec.steps)
    bit = {what: i for i, what in enumerate(dict.fromkeys(asked))}
    subject, words = _mask_exprs(tuple(bit))
    masked = entries.select(*[F.col(c) for c in keep], subject, F.col("event_data")).select(*[F.col(c) for c in keep], *words)
    return masked, [f"_m{w}" for w in range(len(words))], [bit[what] for what in asked]


@functools.lru_cache(maxsize=64)  # the same expressions for the same steps, some hundred calls to build
def _mask_exprs(asked: tuple) -> tuple[Column, list[Column]]:
    subject = match_subject(F.col("message"), F.col("event_data")).alias("_subject")
    preds = [matches_step(F.col("_subject"), F.col("event_data"), Step("step", pattern, dict(props))) for pattern, props in asked]
    return subject, [w.alias(f"_m{i}") for i, w in enumerate(mask_words(preds))]


def funnel_progress(
    entries: DataFrame,
    spec: FunnelSpec,
    *,
    order_by: Sequence[str],
    chunk_by: Sequence[str] | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """One row ``(total_events_analyzed BIGINT, matches BIGINT)`` for an unlimited walk.

    ``order_by`` must be a total order of the entries (line order for text
    sources, e.g. ``LINE_ORDER``; a unique key for tables).  ``chunk_by`` may
    name columns that are monotone in that order and whose groups never span
    two input partitions (``SPLIT_CHUNK`` for text sources); then no shuffle
    is needed.  With ``partition_by`` every value of these columns (null is one) has an automaton of its own,
    ``order_by`` need only order its entries, and there is one row per value.

    The pass over ``entries`` runs now (it writes narrow rows to shared storage and counts);
    the result is a lazy DataFrame over what it wrote.
    """
    order_by, keys = list(order_by), list(partition_by)
    if not order_by:
        raise ValueError("order_by is required: a DataFrame has no order of its own")
    if keys and chunk_by:
        raise ValueError("partition_by arranges the entries itself; leave out chunk_by")
    taken = [c for c in keys if c in ("total_events_analyzed", "matches")]
    if taken:
        raise ValueError(f"partition_by columns {taken} clash with the result's")
    scratch = Scratch(entries.sparkSession, "funnel")
    keep = list(dict.fromkeys(keys + order_by + list(chunk_by or [])))
    masked, words, bits = step_mask_columns(entries, spec, keep)
    if keys:
        return walk_by(masked, bits, words, keys, order_by, scratch)
    summaries, run_cols, total = walk(masked, bits, words, order_by, chunk_by, scratch)
    matches = fold_runs(summaries, run_cols, spec.k)
    return matches.select(
        F.lit(total).cast("bigint").alias("total_events_analyzed"),
        F.coalesce("matches", F.lit(0).cast("bigint")).alias("matches"),
    )


class FunnelResult:
    """Step, drop-off, summary and report tables of one funnel walk.

    All are lazy projections of the same one-row progress DataFrame.  With ``keys`` the progress has a row for each of their
    values; every table then begins with these columns, and a limit holds for each walk.
    """

    def __init__(self, progress: DataFrame, spec: FunnelSpec, limit: int = 0, keys: Sequence[str] = ()):
        self.progress = progress
        self.spec = spec
        self.limit = int(limit)
        self.keys = [F.col(f"`{k}`") for k in keys]

    # -- closed form -------------------------------------------------------------
    def _m(self) -> Column:
        m = F.col("matches")
        if self.limit != 0:
            cap = max(0, min(self.limit * self.spec.k, _LONG_MAX))
            m = F.least(m, F.lit(cap).cast("bigint"))
        return m

    def _counts(self) -> DataFrame:
        k = self.spec.k
        m = self._m()
        base = self.progress.select(*self.keys, "total_events_analyzed", m.alias("_m"))
        conv = F.expr(f"_m div {k}")
        return base.select(
            *self.keys, "total_events_analyzed",
            F.col("_m").alias("matched_events"),
            conv.cast("bigint").alias("conversions"),
            (F.col("_m") % k).cast("bigint").alias("_rem"),
        )

    def _count_at(self, i: Column) -> Column:
        """Event count of 0-based step ``i`` (a column)."""
        return F.col("conversions") + F.when(i < F.col("_rem"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    def step_array(self) -> Column:
        """The step rows as one array over ``_counts()`` (empty when there are no entries)."""
        c0 = self._count_at(F.lit(0))

        def row(name, i):
            n = self._count_at(i)
            return F.struct(
                (i + 1).cast("int").alias("step_index"), name.alias("name"), n.alias("event_count"),
                F.when(c0 > 0, n / c0 * 100.0).otherwise(F.lit(0.0)).alias("percentage"),
            )

        rows = F.transform(F.array(*[F.lit(s.name) for s in self.spec.steps]), row)
        return F.filter(rows, lambda r: F.col("total_events_analyzed") > 0)

    def drop_array(self) -> Column:
        """The drop-off rows as one array: adjacent steps whose first has events."""
        names = [s.name for s in self.spec.steps]
        pairs = [F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in zip(names, names[1:])]

        def row(pair, i):
            a, b = self._count_at(i), self._count_at(i + 1)
            return F.struct(
                (i + 1).cast("int").alias("step_index"), pair["from"].alias("from"), pair["to"].alias("to"),
                (a - b).alias("events_lost"), F.when(a > 0, (a - b) / a * 100.0).alias("drop_off_rate"), a.alias("_a"),
            )

        empty = F.array().cast("array<struct<`from`:string,`to`:string>>")
        rows = F.transform(F.array(*pairs) if pairs else empty, row)
        return F.filter(rows, lambda r: (F.col("total_events_analyzed") > 0) & (r["_a"] > 0))

    def steps(self) -> DataFrame:
        """``DataFrame[step_index INT, name STRING, event_count BIGINT, percentage DOUBLE]``.

        ``percentage`` is relative to step 1 (0 when step 1 has no events);
        no rows when there are no entries."""
        return self._counts().select(*self.keys, F.inline(self.step_array()))

    def drop_offs(self) -> DataFrame:
        """``DataFrame[step_index INT, from STRING, to STRING, events_lost BIGINT, drop_off_rate DOUBLE]``.

        One row per adjacent step pair whose first step has events."""
        return self._counts().select(*self.keys, F.inline(self.drop_array())).drop("_a")

    def report(self) -> DataFrame:
        """One row ``report STRING``: the result as one JSON document."""
        if self.keys:
            raise ValueError("a report is of one walk; a keyed funnel has many")
        from ..plans.report import funnel_report  # the report sink builds on this class

        return funnel_report(self)

    def summary(self) -> DataFrame:
        """One row: ``funnel_name, total_events_analyzed, funnel_completed, conversions, matched_events``."""
        return self._counts().select(
            *self.keys, F.lit(self.spec.name).alias("funnel_name"),
            F.coalesce(F.col("total_events_analyzed"), F.lit(0).cast("bigint")).alias("total_events_analyzed"),
            (F.col("conversions") > 0).alias("funnel_completed"),
            F.col("conversions"),
            F.col("matched_events"),
        )


def analyze_funnel(
    entries: DataFrame,
    spec: FunnelSpec,
    *,
    order_by: Sequence[str],
    chunk_by: Sequence[str] | None = None,
    partition_by: Sequence[str] = (),
    limit: int = 0,
) -> FunnelResult:
    """Walk ``entries`` in ``order_by`` order through ``spec``; ``limit`` stops after that
    many completed conversions (0: no limit; negative: stop at once).  ``partition_by`` (off by default) gives
    each value of these columns a walk of its own."""
    progress = funnel_progress(entries, spec, order_by=order_by, chunk_by=chunk_by, partition_by=partition_by)
    return FunnelResult(progress, spec, limit, partition_by)


def funnel_steps(entries: DataFrame, spec: FunnelSpec, **kw) -> DataFrame:
    return analyze_funnel(entries, spec, **kw).steps()


def funnel_drop_offs(entries: DataFrame, spec: FunnelSpec, **kw) -> DataFrame:
    return analyze_funnel(entries, spec, **kw).drop_offs()


def funnel_summary(entries: DataFrame, spec: FunnelSpec, **kw) -> DataFrame:
    return analyze_funnel(entries, spec, **kw).summary()
