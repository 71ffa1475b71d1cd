"""Exact top-k search by inner product: norm-sorted blocks, rotated partial sums.

Vectors are turned into integers (``floor(scale * x)``), so scores are exact.
All vectors are sorted by descending length into blocks; the queries form blocks of their own.  A
rotation by the singular vectors of the whole table (from its d x d second-moment matrix) puts most of
a vector into its first few coordinates.  A task holds one query block and one stripe of
candidate blocks, in descending length, and keeps a threshold per query, its k-th
score so far:

* a block whose longest vector cannot reach the threshold (Cauchy-Schwarz on the lengths) is
  skipped for that query, and once it is so for all queries the rest of the stripe is too;
* otherwise the partial product over the first coordinates plus the product of the residual lengths bounds
  each score (Cauchy-Schwarz on the residuals); only pairs that may reach the threshold get their exact integer product.

The first round joins the queries with the stripe of the longest vectors alone; its k-th scores are the
thresholds that the second round starts from.  From them follows the smallest length that can still reach a
query block's thresholds; a block of candidates is sent only to the query blocks that it can reach.  Each task returns at most k candidates per query, ranked in
a last window.

Every pair of query block and stripe is one bounded task (``query_rows`` and
``stripe_blocks * block_rows`` vectors); replication is by block.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
shorter vectors count as padded with zeros; rows that repeat an id and vector are one, of different vectors under one id the smallest
stands; ties go to the smaller id; components of any finite size are exact (products that could pass 2^53 are made in
whole numbers), and only a result score that does not fit a BIGINT is an error; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["integer_vectors", "top_k"]

NARROW = float(1 << 31)  # components below it are held as 32-bit integers, larger ones as doubles, which hold them exactly
TOO_LOW, NO_FIT = -(1 << 63), "a score does not fit a BIGINT"
EXACT = float(1 << 52)  # doubles count whole numbers up to here


def _integer_task(scale):
    def run(batches):
        for batch in batches:
            ids, vectors = batch.column("id"), batch.column("vector")
            keep = pc.and_(pc.is_valid(ids), pc.is_valid(vectors))
            ids, vectors = ids.filter(keep), vectors.filter(keep)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))])
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls turn into nan
            whole, bad = np.floor(scale * flat), np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            out_ids, out, norms, sizes = [], [], [], []
            for row, i in enumerate(ids.to_pylist()):
                a, b = int(ends[row]), int(ends[row + 1])
                if bad[a] != bad[b]:
                    continue
                x = np.trim_zeros(whole[a:b], "b")
                narrow = not len(x) or np.abs(x).max() < NARROW
                out_ids.append(i), out.append(x.astype("<i4" if narrow else "<f8").tobytes()), sizes.append(len(x))
                norms.append(float(np.sqrt(x @ x)))
            yield pa.RecordBatch.from_pydict({
                "vec_id": pa.array(out_ids, pa.int64()), "v": pa.array(out, pa.binary()),
                "norm": pa.array(norms, pa.float64()), "size": pa.array(sizes, pa.int32()),
            })

    return run


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id BIGINT, v BINARY (32-bit integers or doubles, no trailing zeros), norm DOUBLE, size INT``, one row per id."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    made = rows.mapInArrow(_integer_task(scale), "vec_id bigint, v binary, norm double, size int")
    return made.groupBy("vec_id").agg(F.min(F.struct("v", "norm", "size")).alias("_v")).select("vec_id", "_v.*")


def _matrix(raws, sizes, d: int) -> np.ndarray:
    out = np.zeros((len(raws), d))
    for row, raw, n in zip(out, raws, sizes):
        row[:n] = np.frombuffer(raw, "<i4" if len(raw) == 4 * n else "<f8")
    return out


def _moment_task(d):
    def run(batches):
        total = np.zeros((d, d))
        for pdf in batches:
            m = _matrix(pdf["v"], pdf["size"], d)
            total += m.T @ m
        yield pd.DataFrame({"row": np.arange(d, dtype=np.int32), "sums": list(total)})

    return run


def _rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """The eigenvectors of the second moments, strongest first; d x d numbers reach the driver."""
    parts = vectors.select("v", "size").mapInPandas(_moment_task(d), "row int, sums array<double>")
    cells = parts.select("row", F.posexplode("sums").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x")).collect()
    moments = np.zeros((d, d))
    for c in cells:
        moments[c["row"], c["col"]] = c["x"]
    _, vectors = np.linalg.eigh((moments + moments.T) / 2)
    return vectors[:, ::-1].copy()


def _block_task(rows_per_block: int):
    """Packs a sorted partition into blocks; a block is numbered within its partition."""

    def run(batches):
        held, number, part = None, 0, None

        def pack(pdf):
            width = int(pdf["size"].max())
            if all(len(v) == 4 * n for v, n in zip(pdf["v"], pdf["size"])):
                raw = b"".join(v.ljust(4 * width, b"\0") for v in pdf["v"])
            else:
                raw = _matrix(pdf["v"], pdf["size"], width).tobytes()
            return {"part": part, "number": number, "norm": float(pdf["norm"].max()), "width": width,
                    "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "m": raw}

        for pdf in batches:
            part = int(pdf["part"].iloc[0]) if len(pdf) else part
            held = pdf if held is None else pd.concat([held, pdf])
            while len(held) >= rows_per_block:
                yield pd.DataFrame([pack(held.iloc[:rows_per_block])])
                held, number = held.iloc[rows_per_block:], number + 1
        if held is not None and len(held):
            yield pd.DataFrame([pack(held)])

    return run


def _blocks(vectors: DataFrame, rows_per_block: int) -> DataFrame:
    """``part, number, norm, width, ids, m``: blocks of vectors by descending length; ties are dealt by id."""
    order = [F.col("norm").desc(), F.col("vec_id")]
    dealt = vectors.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return dealt.mapInPandas(_block_task(rows_per_block), "part int, number int, norm double, width int, ids binary, m binary")


def _numbered(blocks: DataFrame) -> DataFrame:
    """``blocks`` plus ``place INT``, their number in descending length; only (part, number, norm) is ordered in one task."""
    order = Window.orderBy(F.col("norm").desc(), "part", "number")
    places = blocks.select(
        F.col("part").alias("_part"), F.col("number").alias("_number"), (F.row_number().over(order) - 1).alias("place")
    )
    return blocks.join(places, (F.col("part") == F.col("_part")) & (F.col("number") == F.col("_number"))).drop("_part", "_number")


def _unpack(row, d):
    ids = np.frombuffer(row.ids, np.int64)
    m = np.zeros((len(ids), d))
    kind = "<i4" if len(row.m) == 4 * len(ids) * row.width else "<f8"
    m[:, : row.width] = np.frombuffer(row.m, kind).reshape(len(ids), row.width)
    return ids, m


def _best(rows, ids, scores, k):
    """The k best of (query row, id, score) triples per query row, ties to smaller ids."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows)
    top = np.arange(len(rows)) - first < k
    return rows[top], ids[top], scores[top]


def _whole_products(a, b) -> np.ndarray:
    """Inner products of two lists of rows of whole numbers of any size.

    One above the range of a BIGINT is a result, or others above it are, so it is an error; one below stands as ``TOO_LOW``, the last of all."""
    found = [sum(int(x) * int(y) for x, y in zip(p, q) if x and y) for p, q in zip(a, b)]
    if any(x >= 1 << 63 for x in found):
        raise OverflowError(NO_FIT)
    return np.array([max(x, TOO_LOW) for x in found], dtype=np.int64)


def _search(queries, blocks, floor, rotation, head, k, d):
    """The k best candidates of one query block among candidate blocks given in descending length."""
    q_ids, q = queries
    turned = q @ rotation
    q_norm = np.sqrt((q * q).sum(axis=1))
    q_rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
    bar = floor.copy()
    rows, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for block in blocks:
        slack = 1e-6 * (1.0 + q_norm * block.norm)
        live = np.flatnonzero(q_norm * block.norm + slack >= bar)
        if not len(live):
            break  # lengths only fall from here on
        c_ids, c = _unpack(block, d)
        there = c @ rotation
        c_rest = np.sqrt((there[:, head:] ** 2).sum(axis=1))
        bound = turned[live, :head] @ there[:, :head].T + np.outer(q_rest[live], c_rest) + slack[live, None]
        may = (bound >= bar[live, None]) & (q_ids[live, None] != c_ids[None, :])
        if q_norm[live].max() * block.norm >= EXACT:  # doubles may round; each survivor is multiplied out in whole numbers
            i, j = np.nonzero(may)
            found = _whole_products(q[live[i]], c[j])
        elif may.mean() > 0.05:  # many survivors: one exact product of integers held as doubles
            exact = q[live] @ c.T
            exact[~may] = -np.inf
            if exact.shape[1] > k:
                kth = np.partition(exact, exact.shape[1] - k, axis=1)[:, exact.shape[1] - k]
                may &= exact >= np.maximum(kth, bar[live])[:, None]
            i, j = np.nonzero(may)
            found = exact[i, j]
        else:
            i, j = np.nonzero(may)
            found = np.einsum("ij,ij->i", q[live[i]], c[j]) if len(i) else np.empty(0)
        rows = np.concatenate([rows, live[i]])
        ids, scores = np.concatenate([ids, c_ids[j]]), np.concatenate([scores, found.astype(np.int64)])
        rows, ids, scores = _best(rows, ids, scores, k)
        full = np.bincount(rows, minlength=len(q_ids)) >= k
        last = np.searchsorted(rows, np.arange(len(q_ids)), "right") - 1
        bar = np.where(full, np.maximum(bar, scores[np.maximum(last, 0)] if len(scores) else bar), bar)
    return q_ids[rows], ids, scores


def _search_task(rotation, head, k, d):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        blocks = list(right.sort_values(["norm", "part", "number"], ascending=[False, True, True]).itertuples()) if len(right) else []
        for row in left.itertuples():
            floor = np.frombuffer(row.floor, np.float64) if row.floor else np.full(len(row.ids) // 8, -np.inf)
            found = _search(_unpack(row, d), blocks, floor, rotation.value, head, k, d)
            for name, values in zip(out, found):
                out[name].append(values)
        return pd.DataFrame({name: np.concatenate(v) if v else np.empty(0, np.int64) for name, v in out.items()})

    return run


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _need(block, floor: np.ndarray, d: int) -> float:
    """The smallest length of a candidate that can reach a threshold of the query block (Cauchy-Schwarz, with a slack)."""
    norms = np.sqrt((_unpack(block, d)[1] ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(floor <= 0, 0.0, floor / norms)  # a threshold of 0 or less is in reach of any length
    return float(least.min()) * (1 - 1e-6) - 1e-6


def _floors(k, d):
    """Adds to each query block its queries' k-th scores from the first round, and the length it needs."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left.copy()
        known = dict(zip(right["query_id"], right["floor"]))
        floors = [np.array([known.get(i, -np.inf) for i in np.frombuffer(ids, np.int64).tolist()]) for ids in left["ids"]]
        out["floor"] = [f.tobytes() for f in floors]
        out["need"] = [_need(row, f, d) for row, f in zip(left.itertuples(), floors)]
        return out

    return run


def _in_reach(blocks: DataFrame, needs: list[tuple[int, float]]) -> DataFrame:
    """``blocks`` once for each query block ``q`` whose need they meet; ``needs`` holds two numbers per query block."""
    ordered = sorted(needs, key=lambda x: (x[1], x[0]))
    least = np.array([need for _, need in ordered])
    names = [q for q, _ in ordered]

    @F.pandas_udf("array<int>")
    def reach(norm: pd.Series) -> pd.Series:
        return pd.Series([names[:n] for n in np.searchsorted(least, norm.to_numpy(), "right").tolist()])

    return blocks.withColumn("q", F.explode(reach("norm")))


def top_k(
    df: DataFrame,
    is_query,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    scale: float = 64.0,
    head: int = 16,
    block_rows: int = 2048,
    stripe_blocks: int = 16,
    query_rows: int = 1024,
) -> DataFrame:
    """``query_id, rank INT, vec_id, score BIGINT``: the k best partners of each row that ``is_query`` (a
    condition on ``vec_id``) picks, among all rows but its own."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.save(integer_vectors(df, id_col, vector_col, scale), "vectors")
    d = max(1, vectors.agg(F.max("size")).first()[0] or 1)
    rotation = spark.sparkContext.broadcast(_rotation(vectors, d))
    blocks = scratch.save(_blocks(vectors, block_rows), "blocks")
    stripes = max(1, -(-blocks.count() // stripe_blocks))
    striped = _numbered(blocks).withColumn("stripe", F.pmod("place", F.lit(stripes)).cast("int"))
    asked = scratch.save(_blocks(vectors.filter(is_query), query_rows), "asked")
    queries = scratch.save(
        _numbered(asked).withColumnRenamed("place", "q").withColumn("floor", F.lit(None).cast("binary")).withColumn("need", F.lit(0.0)), "queries"
    )
    each = F.explode(F.sequence(F.lit(0), F.lit(max(1, asked.count()) - 1)))  # the query blocks' numbers

    def search(left: DataFrame, right: DataFrame) -> DataFrame:
        """Query blocks against stripes, one bounded task per pair (keys ``q, stripe`` on both sides)."""
        return left.groupBy("q", "stripe").cogroup(right.groupBy("q", "stripe")).applyInPandas(_search_task(rotation, head, k, d), _FOUND)

    # round one: the longest vectors alone
    longest = striped.filter(F.col("place") == 0).withColumn("stripe", F.lit(0)).withColumn("q", each)
    first = scratch.save(search(queries.withColumn("stripe", F.lit(0)), longest), "first")
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
    owner = queries.select(F.col("q").alias("_q"), F.explode(_id_array("ids")).alias("query_id"))
    floors = floors.join(owner, "query_id").select((F.col("_q") + 0).alias("q"), "query_id", F.col("floor").cast("double").alias("floor"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    armed = scratch.save(queries.groupBy("q").cogroup(floors.groupBy("q")).applyInPandas(_floors(k, d), fields), "armed")
    scratch.drop("vectors", "asked", "queries")
    # round two: every stripe, with the thresholds; the first block is done
    copies = armed.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    needs = [(r["q"], r["need"]) for r in armed.select("q", "need").collect()]  # one row per query block
    rest = _in_reach(striped.filter(F.col("place") > 0), needs)
    second = search(copies, rest)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = first.unionByName(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    fits = F.when(F.col("score") == TOO_LOW, F.raise_error(F.lit(NO_FIT)).cast("bigint")).otherwise(F.col("score"))
    return found.select("query_id", "rank", "vec_id", fits.alias("score"))


def _id_array(column: str):
    """A block's packed ids as an array column."""

    @F.pandas_udf("array<bigint>")
    def unpack(ids: pd.Series) -> pd.Series:
        return ids.map(lambda raw: np.frombuffer(raw, np.int64).tolist())

    return unpack(F.col(column))
