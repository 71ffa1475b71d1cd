"""Merkle manifest of a dataset, with a witness for every row.

Each row is a leaf: the hash of its fields.  The leaves of a group (a language), in
order, make a tree of eight children a node; the group's roots make one more tree above them.

Witnesses grow while the tree does.  A task appends the leaves of one aligned block of
8^4 to an ``Appender``: every node joins the open run of its level and takes that run as its
partial witness, which holds the siblings on its left; each sibling that is completed later
extends it, and a full run (or the last one) closes into a node of the level above.  What a block
leaves is its root, and block roots are appended to the next round's blocks just as leaves were, round after
round, until a group has one root.  On the way down each block's witness from above is
attached to its rows, so a row's witness is complete without a task that sees more than one block.

Shuffles: the narrow leaf rows (never the texts) once by range and once by block; one
row per block after that.  A group of any size is cut into ranges and blocks, so no task
depends on the size of a group.

Defined results: null fields are hashed as ``-``; null groups come first and null ids first in their group; rows with
equal group and id follow in the order of their leaf hash, and equal rows are leaves of their own; a
single leaf is its own root and its witness is empty; an empty table has no rows and no root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .ordered import in_order

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ARITY", "Appender", "leaf_hash", "manifest", "folded", "fold"]

ARITY = 8
DIGEST = 64  # characters of a digest
SLICE = 512  # rows whose witnesses are held at once


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 over each field's UTF-8 byte count, a colon and its text; ``-`` for null."""
    parts = [c.cast("string") for c in fields]
    told = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in parts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


class Appender:
    """A growing tree of ``height`` levels above its leaves (as many as are needed, if None).

    ``runs[k]`` are the runs of siblings of level k, the last one open.  A node's witness at level k is
    its run without itself: a list that the node shares with its siblings, so each later sibling
    extends the witnesses of all before it, and of all leaves below them, at once."""

    def __init__(self, height: int | None = None):
        self.runs: list[list[list[str]]] = [[]]
        self.height = height
        self.closed = False

    def append(self, digest: str, level: int = 0) -> None:
        if level == len(self.runs):
            self.runs.append([])
        runs = self.runs[level]
        if not runs or len(runs[-1]) == ARITY:
            runs.append([])
        runs[-1].append(digest)
        if len(runs[-1]) == ARITY and level != self.height:
            self.append(_sha("".join(runs[-1])), level + 1)

    def close(self) -> str:
        """Completes the open runs from the leaves up; returns the root."""
        level = 0
        while (level < self.height) if self.height is not None else (sum(map(len, self.runs[level])) > 1):
            last = self.runs[level][-1]
            if len(last) < ARITY:
                self.append(_sha("".join(last)), level + 1)
            level += 1
        self.runs, self.closed = self.runs[: level + 1], True
        return self.runs[level][0][0]

    def witness(self, leaf: int) -> tuple[list[int], list[int], str]:
        """(slot and width of each run on the way up, the siblings in it from left to right) as known so far."""
        slots, widths, others = [], [], []
        for runs in self.runs[:-1] if self.closed else self.runs:
            if leaf // ARITY >= len(runs):
                break  # not closed yet
            run, slot = runs[leaf // ARITY], leaf % ARITY
            slots.append(slot)
            widths.append(len(run))
            others += run[:slot] + run[slot + 1 :]
            leaf //= ARITY
        return slots, widths, "".join(others)


def fold(digest: str, slots, widths, siblings: str) -> str:
    """The root that ``digest`` has under a witness."""
    at = 0
    for slot, width in zip(slots, widths):
        left, right = at + slot * DIGEST, at + (width - 1) * DIGEST
        digest = _sha(siblings[at:left] + digest + siblings[left:right])
        at = right
    return digest


def _grown(digests: list[str], height: int | None) -> tuple[Appender, str]:
    tree = Appender(height)
    for digest in digests:
        tree.append(digest)
    return tree, tree.close()


def _blocks_of(batches: Iterator[pa.RecordBatch]):
    """(batch, row, nodes of that block as a struct array), one block at a time."""
    for batch in batches:
        nodes = batch.column(batch.schema.get_field_index("nodes"))
        for i in range(batch.num_rows):
            yield {c: batch.column(k)[i] for k, c in enumerate(batch.schema.names) if c != "nodes"}, nodes[i].values


def _roots(depth: int, first: bool):
    """Each block's root as one block of many (``digest``) and as the only block of its group (``short``)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for row, nodes in _blocks_of(batches):
            digests = nodes.field("digest").to_pylist()
            alone = len(digests) == 1 and row["block"].as_py() == 0
            short = (nodes.field("digest" if first else "short")[0].as_py()) if alone else _grown(digests, None)[1]
            values = [pa.array([x], kind) for x, kind in ((row["grp"].as_py(), row["grp"].type), (row["block"].as_py(), pa.int64()), (_grown(digests, depth)[1], pa.string()), (short, pa.string()))]
            yield pa.RecordBatch.from_arrays(values, names=["grp", "pos", "digest", "short"])

    return run


def _attached(depth: int, names: list[str]):
    """The rows of each block with their whole witness: the block's own, then the one its root has from above."""

    def run(batches: Iterator[pa.RecordBatch]):
        for row, nodes in _blocks_of(batches):
            digests = nodes.field("digest").to_pylist()
            above = {c: row[c].as_py() for c in ("alone", "slots", "widths", "siblings", "subroot", "root")}
            tree, _ = _grown(digests, None if above["alone"] else depth)
            only, lists = above["alone"] and len(digests) == 1, pa.list_(pa.int32())
            for first in range(0, len(digests), SLICE):
                own = [tree.witness(i) for i in range(first, min(first + SLICE, len(digests)))]
                n = len(own)
                columns = [nodes.field(c).slice(first, n) for c in names]
                columns += [pa.array([s + above["slots"] for s, _, _ in own], lists), pa.array([w + above["widths"] for _, w, _ in own], lists)]
                columns += [pa.array([o + above["siblings"] for _, _, o in own], pa.string()), pa.array([only] * n, pa.bool_())]
                columns += [pa.array([row["grp"].as_py()] * n, row["grp"].type), pa.array([above["subroot"]] * n, pa.string()), pa.array([above["root"]] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "slots", "widths", "siblings", "alone", "grp", "subroot", "root"])

    return run


def _up(nodes: DataFrame, carry: list[str], scratch: Scratch, label: str, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round over ``nodes[grp, pos, digest, *carry]``, and each group's root (``grp, digest``)."""
    rounds, size, kind = [], ARITY**depth, nodes.schema["grp"].dataType.simpleString()
    while True:
        held = F.array_sort(F.collect_list(F.struct("pos", "digest", *(["short"] if rounds else carry))))  # at most `size` rows
        blocks = nodes.groupBy("grp", F.expr(f"pos div {size}").alias("block")).agg(held.alias("nodes"))
        rounds.append(scratch.save(blocks, f"{label}-blocks-{len(rounds)}"))
        roots = rounds[-1].mapInArrow(_roots(depth, len(rounds) == 1), f"grp {kind}, pos bigint, digest string, short string")
        nodes = scratch.save(roots, f"{label}-roots-{len(rounds)}")
        if not nodes.filter("pos > 0").limit(1).count():
            return rounds, nodes.select("grp", F.col("short").alias("digest"))


def _down(rounds: list[DataFrame], above: DataFrame, carry: list[str], scratch: Scratch, label: str, depth: int) -> DataFrame:
    """``nodes`` with ``slots, widths, siblings, subroot, root``; ``above`` has those of each group's root."""
    above = above.withColumn("pos", F.lit(0).cast("bigint")).withColumn("alone", F.lit(True))
    for k in reversed(range(len(rounds))):
        blocks, names = rounds[k], ["pos", "digest", *(carry if k == 0 else [])]
        above = above.withColumnRenamed("grp", "_g")
        met = blocks.join(above, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("pos")))  # one row a block on both sides
        held = {f.name: f.dataType.simpleString() for f in blocks.schema["nodes"].dataType.elementType}
        schema = ", ".join(f"{c} {held[c]}" for c in names) + ", slots array<int>, widths array<int>, siblings string, alone boolean"
        schema += f", grp {blocks.schema['grp'].dataType.simpleString()}, subroot string, root string"
        made = met.select("grp", "nodes", "alone", "slots", "widths", "siblings", "subroot", "root").mapInArrow(_attached(depth, names), schema)
        above = made if k == 0 else scratch.save(made, f"{label}-down-{k}")
    return above


def manifest(leaves: DataFrame, *, group: str, order: str, carry: list[str] = (), depth: int = 4) -> DataFrame:
    """One row per row of ``leaves[group, order, leaf, *carry]``: these columns and its place and witness.

    ``pos BIGINT`` is the place in the group, ``subroot`` and ``root`` the roots of the group and of the
    dataset.  The witness lists, level by level from the leaf to the root, the row's slot in its run (``slots``), the
    run's width (``widths``), and in ``siblings`` the digests of the run's others, joined.  ``depth`` is the height of a block."""
    spark = leaves.sparkSession
    scratch = Scratch(spark, "merkle")
    carried = [f"_c{i}" for i in range(len(carry))]
    rows = leaves.select(
        F.col(f"`{group}`").alias("grp"), F.col(f"`{order}`").alias("_id"), F.col("leaf").alias("digest"),
        *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, carried)], F.monotonically_increasing_id().alias("_tie"),
    )
    rows = scratch.save(rows, "leaves")  # the texts are read once, here
    placed = in_order(rows, "grp", ["_id", "digest", "_tie"], scratch, "placed").withColumnRenamed("_at", "pos")
    rounds, subroots = _up(placed, ["_id", *carried], scratch, "leaves", depth)

    heads = scratch.save(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("_name"), "digest"), "heads")
    heads = in_order(heads, "grp", ["_name"], scratch, "heads-placed").withColumnRenamed("_at", "pos")
    upper, top = _up(heads, ["_name"], scratch, "groups", depth)
    none = F.array().cast("array<int>")
    top = top.select("grp", none.alias("slots"), none.alias("widths"), F.lit("").alias("siblings"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    roots = _down(upper, top, ["_name"], scratch, "groups", depth)
    above = roots.select(F.col("_name").alias("grp"), "slots", "widths", "siblings", F.col("digest").alias("subroot"), "root")
    made = _down(rounds, scratch.save(above, "subroots"), ["_id", *carried], scratch, "leaves", depth)
    return made.select(
        F.col("grp").alias(group), F.col("_id").alias(order), F.col("digest").alias("leaf"), *[F.col(n).alias(c) for c, n in zip(carry, carried)],
        "pos", "subroot", "root", "slots", "widths", "siblings",
    )


def folded(rows: DataFrame, digest: str, name: str = "folded_root") -> DataFrame:
    """``rows`` of a manifest plus the root that the digest in column ``digest`` has under the row's witness."""

    def task(start, slots, widths, siblings):
        return pd.Series([None if d is None else fold(d, s, w, o) for d, s, w, o in zip(start, slots, widths, siblings)], dtype="object")

    return rows.withColumn(name, F.pandas_udf(task, "string")(digest, "slots", "widths", "siblings"))
