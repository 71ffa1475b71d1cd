"""Ordered funnel walk as a parallel, associative fold.

The funnel is one automaton with k states that walks the entries in order and
advances by one each time an entry matches the step it is waiting for.  Any
run of consecutive entries is fully described by ``adv[s]``: how many matches
the run makes when entered in state ``s``.  Runs compose associatively::

    adv12[s] = adv1[s] + adv2[(s + adv1[s]) mod k]

so the walk parallelises: entries are arranged into runs that are contiguous in
the global order, each task reduces its runs to k numbers, and the few run
summaries are folded in order at the end.  Only entries that match at least one
step matter (the rest leave every state unchanged), so they alone travel.

Arrangement:

* ``chunk_by`` given (text sources): a chunk is a file split, which always lies
  inside one task, so a local ``sortWithinPartitions`` is enough - no shuffle.
* otherwise (tables): the matching rows' order columns and step bits are written once, then
  ``repartitionByRange`` on the order columns (sampled bounds, so chunks are
  balanced whatever the key distribution; a unique order key cannot be skewed) and
  a local sort; each range partition is one run.

The plan has the same form at every size, and reads its input once.

Within a run the walk is followed from all start states at once (``Trajectories``): two starts
that wait for the same step are one from there on, so a state has one trajectory at most, an entry
moves only those that wait for what it matches, and soon few are left.  The work follows the matches of the
trajectories that are left, not the number of steps.  Steps with equal predicates share one bit, so
a predicate is evaluated once however often the funnel asks for it.  This is a streaming pass over
Arrow batches behind Spark's spill-capable sort, with k numbers of memory.  Spark SQL has no ordered, stateful
aggregate that could express this without collecting a whole chunk into one
array, which is why this one step runs in Python.

With keys (one automaton per key) the order is (key, order): a key's first entry in a range that does not begin
with it enters in state 0, which leaves a single trajectory; only the key a range begins with is followed from
every state, since it may go on from the range before.  A key of any size may span ranges; its runs are composed like others.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch

# The per-task code below only needs NumPy and pandas; shipping it by value means
# executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BITS_PER_WORD", "mask_words", "compose", "Trajectories", "walk", "walk_by", "fold_levels", "fold_runs", "compose_runs"]

BITS_PER_WORD = 63  # the sign bit stays clear, so words are plain non-negative longs


def mask_words(preds: Sequence[Column]) -> list[Column]:
    """Pack boolean predicates into BIGINT bit masks, 63 to a mask."""
    words = []
    for start in range(0, len(preds), BITS_PER_WORD):
        word = F.lit(0).cast("bigint")
        for b, p in enumerate(preds[start : start + BITS_PER_WORD]):
            word = word.bitwiseOR(F.when(p, F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        words.append(word)
    return words


def compose(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Summary of run a followed by run b."""
    return a + b[(np.arange(k) + a) % k]


class Trajectories:
    """The walk of one run from several start states at once.

    ``bits[s]`` is the bit that an entry's mask has set if it matches step s."""

    def __init__(self, bits: Sequence[int], starts: Sequence[int] | None = None):
        self.bits, k = list(bits), len(bits)
        self.starts = list(range(k)) if starts is None else list(starts)
        self.at: dict[int, int] = {s: s for s in self.starts}  # the trajectory that waits in a state
        self.made = {s: 0 for s in self.starts}  # matches of a trajectory while it was on its own
        self.joined: dict[int, tuple[int, int]] = {}  # trajectory -> (the one it joined, its matches beyond that one's)
        self.waiting: dict[int, set[int]] = {}
        for s in self.starts:
            self.waiting.setdefault(self.bits[s], set()).add(s)
        self.awaited = sum(1 << b for b in self.waiting)

    def feed(self, masks: Sequence[int]) -> None:
        """Goes on over the entries' masks, in order."""
        k, bits, at, made, waiting = len(self.bits), self.bits, self.at, self.made, self.waiting
        for i, mask in enumerate(masks):
            if len(at) == 1:
                return self._alone(masks, i)
            hit = mask & self.awaited
            if not hit:
                continue
            moved = []
            while hit:
                low = hit & -hit
                moved += waiting.pop(low.bit_length() - 1)
                hit ^= low
            self.awaited &= ~mask
            going = [(s, at.pop(s)) for s in moved]
            for s, t in going:
                made[t] += 1
                n = s + 1 if s + 1 < k else 0
                other = at.get(n)
                if other is None:
                    at[n] = t
                    waiting.setdefault(bits[n], set()).add(n)
                    self.awaited |= 1 << bits[n]
                else:
                    self.joined[t] = (other, made[t] - made[other])

    def _alone(self, masks: Sequence[int], first: int) -> None:
        ((state, t),) = self.at.items()
        n, k, bits = 0, len(self.bits), self.bits
        for mask in masks[first:] if first else masks:
            if mask >> bits[state] & 1:
                n += 1
                state = state + 1 if state + 1 < k else 0
        self.made[t] += n
        self.at, self.waiting, self.awaited = {state: t}, {bits[state]: {state}}, 1 << bits[state]

    def advances(self) -> list[int]:
        """Matches made from each start state."""
        total = {}
        for start in self.starts:
            path, t = [], start
            while t not in total and t in self.joined:
                path.append(t)
                t = self.joined[t][0]
            total.setdefault(t, self.made[t])
            for t in reversed(path):
                total[t] = total[self.joined[t][0]] + self.joined[t][1]
        return [total[s] for s in self.starts]


def _masks(batch: pa.RecordBatch, words: Sequence[str]) -> list[int]:
    """The mask of each row as one integer."""
    first, *more = [batch.column(batch.schema.get_field_index(w)).to_pylist() for w in words]
    return first if not more else [sum(x << (BITS_PER_WORD * i) for i, x in enumerate(row)) for row in zip(first, *more)]


def _new_runs(batch: pa.RecordBatch, names: Sequence[str], last: tuple | None) -> tuple[list[int], tuple]:
    """(rows at which ``names`` differ from the row before, the values of the last row); null equals null."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
    fresh = np.zeros(batch.num_rows, bool)
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        fresh[1:] |= codes[1:] != codes[:-1]
    fresh[0] = last is None or tuple(c[0].as_py() for c in columns) != last
    return np.flatnonzero(fresh).tolist(), tuple(c[batch.num_rows - 1].as_py() for c in columns)


def _follower(bits: Sequence[int], run_cols: list[str], words: list[str], keyed: bool):
    """Per task: one summary per run (maximal stretch of equal ``run_cols``) of entries given in order.

    ``keyed``: a run that is not its task's first begins its key, so it is followed from state 0 alone."""

    def summaries(made, kinds):
        columns = [pa.array(c, t) for c, t in zip(zip(*[key for key, _, _ in made]), kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([a for _, a, _ in made], pa.list_(pa.int64())), pa.array([n for _, _, n in made], pa.int64())], names=[*run_cols, "adv", "rows"])

    def follow(batches):
        last, walker, rows, first, kinds = None, None, 0, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = kinds or [batch.schema.field(c).type for c in run_cols]
            masks, made = _masks(batch, words), []
            keys = [batch.column(batch.schema.get_field_index(c)) for c in run_cols]
            starts, end = _new_runs(batch, run_cols, last)
            if walker and (not starts or starts[0]):  # the run of the batch before goes on
                upto = starts[0] if starts else batch.num_rows
                walker.feed(masks[:upto])
                rows += upto
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                if walker:
                    made.append((last, walker.advances(), rows))
                    first = False
                walker, rows, last = Trajectories(bits, [0] if keyed and not first else None), b - a, tuple(c[a].as_py() for c in keys)
                walker.feed(masks[a:b])
            last = end
            if made:
                yield summaries(made, kinds)
        if walker:
            yield summaries([(last, walker.advances(), rows)], kinds)

    return follow


def _composer(k: int, run_cols: list[str], unique_cols: list[str]):
    """Per task: finer run summaries (``adv`` of each, told apart by ``unique_cols``) composed per stretch of equal ``run_cols``.

    Two adjacent summaries of the same finer run mean a chunk was split across tasks, which would break the order: that raises."""

    def summarize(batches):
        key, acc, rows, last_unique = None, None, 0, None
        out_keys, out_adv, out_rows = [], [], []
        for pdf in batches:
            if pdf.empty:
                continue
            finer = pdf[unique_cols]
            repeated = ~(finer != finer.shift()).any(axis=1).to_numpy()
            repeated[0] = last_unique is not None and tuple(finer.iloc[0]) == last_unique
            if repeated.any():
                raise RuntimeError(SPLIT_CHUNK_ERROR)
            last_unique = tuple(finer.iloc[-1])
            for seg_key, adv, n in zip(pdf[run_cols].itertuples(index=False, name=None), pdf["adv"], pdf["rows"]):
                adv = np.asarray(adv, dtype=np.int64)
                if key is not None and seg_key == key:
                    acc, rows = compose(acc, adv, k), rows + n
                else:
                    if key is not None:
                        out_keys.append(key), out_adv.append(acc.tolist()), out_rows.append(rows)
                    key, acc, rows = seg_key, adv, n
        if key is not None:
            out_keys.append(key), out_adv.append(acc.tolist()), out_rows.append(rows)
            res = pd.DataFrame(out_keys, columns=run_cols)
            res["adv"] = out_adv
            res["rows"] = out_rows
            yield res

    return summarize


def _summary_schema(arranged: DataFrame, run_cols: list[str]) -> T.StructType:
    return T.StructType(
        [T.StructField(c, arranged.schema[c].dataType, True) for c in run_cols]
        + [T.StructField("adv", T.ArrayType(T.LongType())), T.StructField("rows", T.LongType())]
    )


def walk(
    masked: DataFrame,
    bits: Sequence[int],
    word_cols: Sequence[str],
    order_by: Sequence[str],
    chunk_by: Sequence[str] | None,
    scratch: Scratch,
) -> tuple[DataFrame, list[str], int]:
    """(run summaries, their key columns, number of entries) of ``masked[*order, *words]``; ``bits`` gives each step's bit.

    The one pass over the input writes what the fold needs to shared storage and counts the
    entries on the way.  From a text source that is one summary per file split; from a
    table it is the order columns and step bits of the matching entries, which are then
    ranged into an explicit number of runs (``RUN_ROWS`` entries each, and
    ``spark.sql.shuffle.partitions`` of them at least).  Summaries are folded in levels until
    ``FAN_IN`` are left, by their real number.
    """
    order_by, words, k = list(order_by), list(word_cols), len(bits)
    total = Observation()
    any_match = F.lit(False)
    for w in words:
        any_match = any_match | (F.col(w) != 0)
    keep = list(dict.fromkeys([*order_by, *(chunk_by or [])]))
    # keep matching rows with a generator rather than a filter: a filter would be
    # pushed below the projection and evaluate every step regex a second time
    matching = masked.observe(total, F.count(F.lit(1)).alias("n")).select(
        *[F.col(c) for c in keep], F.inline(F.when(any_match, F.array(F.struct(*[F.col(w) for w in words]))))
    )
    if chunk_by:
        run_cols = list(chunk_by)
        arranged = matching.sortWithinPartitions(*run_cols, *[c for c in order_by if c not in run_cols])
        summaries = scratch.save(_summaries(arranged, bits, run_cols, words), "runs")
        runs = summaries.count()
    else:
        run_cols = ["_run"]
        matching = scratch.save(matching, "matching")
        runs = range_count(matching)
        cols = [F.col(c).asc_nulls_first() for c in order_by]
        arranged = matching.repartitionByRange(runs, *cols).sortWithinPartitions(*cols)
        summaries = _summaries(arranged.withColumn("_run", F.spark_partition_id()), bits, run_cols, words)
    summaries, run_cols = fold_levels(summaries, run_cols, k, runs)
    return summaries, run_cols, total.get.get("n", 0)


def _summaries(arranged: DataFrame, bits: Sequence[int], run_cols: list[str], words: list[str], keyed: bool = False) -> DataFrame:
    """``DataFrame[*run_cols, adv ARRAY<BIGINT>, rows BIGINT]``, one row per run."""
    return arranged.select(*run_cols, *words).mapInArrow(_follower(bits, run_cols, words, keyed), _summary_schema(arranged, run_cols))


def walk_by(masked: DataFrame, bits: Sequence[int], word_cols: Sequence[str], keys: Sequence[str], order_by: Sequence[str], scratch: Scratch) -> DataFrame:
    """``DataFrame[*keys, total_events_analyzed, matches]``: one automaton per key, over ``masked[*keys, *order, *words]``.

    The one pass over the input writes keys, order and step bits of every entry; these narrow rows are ranged by (key, order),
    so the entries of one key may lie in many ranges.  What meets per key is one summary for each range that has it."""
    keys, words, k = list(keys), list(word_cols), len(bits)
    order = [c for c in order_by if c not in keys]
    rows = scratch.save(masked.select(*keys, *order, *words), "keyed")
    cols = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    arranged = rows.repartitionByRange(range_count(rows), *cols).sortWithinPartitions(*cols).withColumn("_run", F.spark_partition_id())
    runs = _summaries(arranged, bits, [*keys, "_run"], words, keyed=True)
    held = F.array_sort(F.collect_list(F.struct("_run", "adv")))  # one per range
    folded = F.aggregate(held, F.lit(0).cast("bigint"), lambda m, r: m + F.element_at(r["adv"], (m % F.lit(k)).cast("int") + 1))
    return runs.groupBy(*keys).agg(F.sum("rows").alias("total_events_analyzed"), folded.alias("matches"))


def range_count(matching: DataFrame) -> int:
    """How many runs a table's matching entries are ranged into."""
    floor = int(matching.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, floor, -(-matching.count() // RUN_ROWS))


SPLIT_CHUNK_ERROR = "funnel chunks were split across tasks; chunk_by columns must not be shuffled"
RUN_ROWS = 1 << 20  # matching entries of one range
FAN_IN = 2048  # most run summaries folded by one task
GROUP = 256  # runs composed per task in a level


def fold_levels(summaries: DataFrame, run_cols: list[str], k: int, runs: int) -> tuple[DataFrame, list[str]]:
    """Compose ``runs`` run summaries into contiguous groups until at most ``FAN_IN`` remain.

    Each level ranges the summaries (k numbers each) into groups of about ``GROUP``
    neighbouring runs, composed by the same summarizer."""
    level = 0
    while runs > FAN_IN:
        level += 1
        group_col = f"_grp{level}"
        runs = -(-runs // GROUP)
        cols = [F.col(c).asc_nulls_first() for c in run_cols]
        arranged = (
            summaries.repartitionByRange(runs, *cols)
            .sortWithinPartitions(*cols)
            .select(*run_cols, F.spark_partition_id().alias(group_col), "adv", "rows")
        )
        summaries = arranged.mapInPandas(
            _composer(k, [group_col], list(run_cols)),
            _summary_schema(arranged, [group_col]),
        )
        run_cols = [group_col]
    return summaries, run_cols


def fold_runs(summaries: DataFrame, run_cols: list[str], k: int) -> DataFrame:
    """One row ``matches``: fold the run summaries in run order from state 0.

    ``fold_levels`` bounds the number of summaries, so one small task folds them.
    A run key seen twice means a chunk was split across tasks (its rows were
    shuffled after the scan), which would break the order: that fails loudly."""
    runs = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in run_cols], F.col("adv"))))
    folded = F.aggregate(
        runs,
        F.lit(0).cast("bigint"),
        lambda m, r: m + F.element_at(r["adv"], (m % F.lit(k)).cast("int") + 1),
    )
    keys = F.transform(runs, lambda r: F.struct(*[r[c] for c in run_cols]))
    checked = F.when(F.size(F.array_distinct(keys)) == F.size(runs), folded).otherwise(
        F.raise_error(F.lit(SPLIT_CHUNK_ERROR))
    )
    return summaries.agg(checked.cast("bigint").alias("matches"))


def compose_runs(summaries: DataFrame, run_cols: list[str], k: int) -> DataFrame:
    """One row ``(adv ARRAY<BIGINT>, rows BIGINT)``: all runs composed in run order.

    Unlike ``fold_runs`` this keeps the whole summary (every start state), so
    the result can itself be composed with what comes before or after it,
    e.g. across the micro-batches of a stream."""
    runs = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in run_cols], F.col("adv"))))
    ident = F.array_repeat(F.lit(0).cast("bigint"), k)
    steps = F.sequence(F.lit(0), F.lit(k - 1))

    def step(acc, r):
        return F.transform(steps, lambda s: acc[s] + F.element_at(r["adv"], ((s + acc[s]) % k).cast("int") + 1))

    return summaries.agg(
        F.aggregate(runs, ident, step).alias("adv"),
        F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("rows"),
    )
