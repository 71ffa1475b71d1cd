"""Positions and running digests of rows in an order, group by group, without one task per group.

Rows are ranged by (group, order) and sorted within their partition, so a group that
holds a third of all rows is cut into many ranges.  One streaming pass numbers the rows of
each range and folds their digests; what a range has to add from the ranges before it is
known from one row per range and group that spans ranges, i.e. at most two rows per partition.

The fold is ``key = key * BASE + digest mod 2^127 - 1``: order matters, and a run of rows acts as an affine
map, so runs compose.  Digests are SHA-256, so unlike rows do not meet by construction of their bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["in_order", "ROOT"]

PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1B54A32D192ED03A1F2B4C7
ROOT = "0" * 32  # the key before the first row


def _hex(key: int) -> str:
    return f"{key:032x}"


def _number(group: str, digest: str | None):
    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        last, count, key = None, 0, 0  # the group being read, its rows and its key so far in this range
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(group))
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            fresh = np.concatenate([[last is None or column[0].as_py() != last[0]], codes[1:] != codes[:-1]])
            at = np.arange(len(codes))
            first = np.maximum.accumulate(np.where(fresh, at, -1))
            n = np.where(first < 0, at + count, at - first)
            columns = [pa.array(np.full(len(n), part, "i4")), pa.array(n)]
            if digest:
                before, after = [], []
                for new, x in zip(fresh.tolist(), batch.column(batch.schema.get_field_index(digest)).to_pylist()):
                    key = 0 if new else key
                    before.append(_hex(key))
                    key = (key * BASE + int(x, 16)) % PRIME
                    after.append(_hex(key))
                columns += [pa.array(before), pa.array(after)]
            last, count = (column[-1].as_py(),), int(n[-1]) + 1
            names = [*batch.schema.names, "_part", "_n", *(["_up", "_key"] if digest else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return run


def _carried(runs: list[tuple]) -> list[tuple]:
    """(part, group, rows before, key before) of the ranges that go on with a group, from (part, group, rows, key)."""
    out, so_far = [], {}
    for part, group, n, key in sorted(runs, key=lambda r: r[0]):
        count, value = so_far.get(group, (0, 0))
        if count:
            out.append((part, group, count, _hex(value)))
        so_far[group] = count + n, (value * pow(BASE, n, PRIME) + int(key, 16)) % PRIME
    return out


def _joined(key, n, carry):
    return [k if c is None else _hex((int(c, 16) * pow(BASE, int(i), PRIME) + int(k, 16)) % PRIME) for k, i, c in zip(key, n, carry)]


def in_order(rows: DataFrame, group: str, order: list[str], scratch: Scratch, label: str, digest: str | None = None) -> DataFrame:
    """``rows`` plus ``_at BIGINT``, the place (from 0) in its group by ``order`` (ascending, nulls first).

    With ``digest`` (a column of hexadecimal text) also ``_up`` and ``_key``, the folded digests of the group's rows
    before and up to this one.  ``rows`` is read twice (range bounds are sampled), so pass a stored table.  Rows equal in
    ``group`` and ``order`` may change places; add a column that tells them apart where that matters."""
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_n", T.LongType())]
    extra += [T.StructField(c, T.StringType()) for c in ("_up", "_key")] if digest else []
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = scratch.save(ranged.mapInArrow(_number(group, digest), T.StructType([*rows.schema.fields, *extra])), label)
    key = F.max_by("_key", "_n") if digest else F.lit(ROOT)
    runs = placed.groupBy("_part", group).agg((F.max("_n") + 1).alias("n"), key.alias("k"))
    spanning = runs.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(group))).filter("_parts > 1")
    carried = _carried([tuple(r) for r in spanning.select("_part", group, "n", "k").collect()])  # at most two per partition
    if not carried:
        return placed.withColumnRenamed("_n", "_at").drop("_part")
    kind = rows.schema[group].dataType
    schema = T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_g", kind), T.StructField("_before", T.LongType()), T.StructField("_carry", T.StringType())])
    offsets = rows.sparkSession.createDataFrame(carried, schema)
    met = placed.join(F.broadcast(offsets), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    out = [*[F.col(c) for c in rows.columns], (F.col("_n") + F.coalesce("_before", F.lit(0))).alias("_at")]
    if digest:
        import pandas as pd

        joined = F.pandas_udf(lambda k, n, c: pd.Series(_joined(k, n, c), dtype="object"), "string")
        out += [joined("_up", "_n", "_carry").alias("_up"), joined("_key", F.col("_n") + 1, "_carry").alias("_key")]
    return met.select(*out)
