"""Prefix trie of conversations, by peeling them from their ends.

A node is a distinct sequence of first turns; a conversation is a member of the nodes of all its
prefixes.  Turns are reduced to a digest and a length where they are read; the key
of a prefix is the fold of its turns' digests (``ordered.in_order``), so equal keys are equal sequences.

Peeling: at depth d the conversations that end there join the nodes that are left from below; they
are regrouped by their key, which finds the nodes of that depth and sums what their
children brought along (members, leaves, savings) at once.  Then the last turn is stripped: a node goes on as a
child of the prefix one shorter.  A round is one group-by and one join on narrow rows, written
to the shared folder.  What only one conversation reaches needs no regrouping: it is peeled to the
deepest prefix it shares in one step, so the rounds are as many as the deepest shared
prefix has turns, not as the longest conversation.

Hot keys: the turns of a conversation of any length are ranged, not gathered; a prefix of many
conversations is pre-aggregated before it moves; the join that names a child's parent reads two stored tables, so
adaptive execution can split a parent of many children; the ids that end at a node travel in blocks of 256 and are hashed
as a stream.

Defined results: null roles and texts are empty; turns with equal place follow by role, then by digest, and repeated
rows are turns of their own; rows without a conv_id belong to no conversation; an empty table has no nodes, not even a root;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .ordered import ROOT, in_order

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["turn_rows", "share_openings", "prefix_trie"]

ENDS = 256  # ids hashed together


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, size``: one narrow row per turn; ``size`` in code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter(F.col("conv_id").isNotNull())
    return rows.select("conv_id", "turn", role.alias("role"), F.sha2(told.cast("binary"), 256).alias("digest"), F.length(text).cast("bigint").alias("size"))


def share_openings(placed: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that open alike, as ``(turns, ids)``.

    ``placed`` holds ``conv_id, _at, digest, size``.  Conversation c takes over the first h turns of conversation
    c - c % ``every`` and keeps its own from there on, where h = crc32(c as text) % (``most`` + 1).
    ``turns``: ``conv_id, part, place, digest, size``; ``ids``: every conv_id, also of conversations without turns."""

    def opening(c):
        return F.crc32(c.cast("string").cast("binary")) % (most + 1)

    ids = placed.select("conv_id").distinct()
    wanted = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("_base"), opening(F.col("conv_id")).alias("_h"))
    first = placed.filter(F.col("_at") < most).withColumnRenamed("conv_id", "_b")
    taken = wanted.join(first, (F.col("_base") == F.col("_b")) & (F.col("_at") < F.col("_h")))
    own = placed.filter(F.col("_at") >= opening(F.col("conv_id")))
    parts = [rows.select("conv_id", F.lit(k).alias("part"), F.col("_at").alias("place"), "digest", "size") for k, rows in enumerate((taken, own))]
    return parts[0].unionByName(parts[1]), ids


def _stream_digests(batches: Iterator[pa.RecordBatch]):
    """SHA-256 of each node's id texts, joined by commas; the rows come sorted by node and block."""
    node, running = None, None
    for batch in batches:
        nodes, digests = [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == node:
                running.update(b",")
            else:
                if running:
                    nodes.append(node)
                    digests.append(running.hexdigest())
                node, running = name, hashlib.sha256()
            running.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(digests, pa.string())], names=["_node", "ends_sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([running.hexdigest()])], names=["_node", "ends_sha256"])


def _node(depth: str = "depth", key: str = "key"):
    return F.concat_ws(":", F.col(depth).cast("string"), key)


def _end_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """``_node, ends_sha256`` from ``depth, key, conv_id``."""
    ends = scratch.save(ends.select(_node().alias("_node"), "conv_id"), "ends")
    placed = in_order(ends, "_node", ["conv_id"], scratch, "ends-placed")
    held = F.array_sort(F.collect_list("conv_id"))  # at most ENDS ids
    blocks = placed.groupBy("_node", F.expr(f"_at div {ENDS}").alias("_block")).agg(F.array_join(F.transform(held, lambda c: c.cast("string")), ",").alias("text"))
    sorted_ = blocks.repartition("_node").sortWithinPartitions("_node", "_block").select("_node", "text")
    return sorted_.mapInArrow(_stream_digests, "_node string, ends_sha256 string")


_NODES = ["depth", "key", "up", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _peel(entering: DataFrame, chain: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Nodes of every depth from the deepest shared one to the root; ``entering`` holds ``depth, key, conv_id, child``."""
    left, levels = None, []
    for d in range(entering.agg(F.max("depth")).first()[0], -1, -1):
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        met = entering.filter(F.col("depth") == d).select(
            "key", "conv_id", one.alias("n"), F.col("child").alias("children"), F.col("child").alias("leaves"), none.alias("saved")
        )
        if left is not None:
            stripped = left.select(F.col("up").alias("key"), "conv_id", F.col("n_convs").alias("n"), one.alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
            met = met.unionByName(stripped)
        found = met.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
        if d:
            last = chain.filter(F.col("depth") == d).select(F.col("conv_id").alias("_c"), "up", "size")
            found = found.join(last, F.col("conv_id") == F.col("_c"))
        else:
            found = found.withColumn("up", F.lit(None).cast("string")).withColumn("size", none)
        nodes = found.select(
            F.lit(d).cast("bigint").alias("depth"), "key", "up", "conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
            F.when(F.col("children") == 0, one).otherwise(F.col("leaves")).alias("n_leaves"),
            (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved_tokens"),
        )
        left = scratch.save(nodes, f"nodes/depth={d}")
        levels.append(left)
    return levels


def prefix_trie(turns: DataFrame, ids: DataFrame, order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Nodes of the trie of ``turns[conv_id, *order, digest, size]``; ``ids[conv_id]`` lists all conversations once.

    ``depth``, ``key`` (of the prefix) and, as BIGINT: ``conv_id``, the smallest member; ``parent_conv_id`` (null for the
    root); ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (code points of turns that a shared
    prefix saves in the subtree); ``ends_sha256`` of the ids that end at the node."""
    spark: SparkSession = turns.sparkSession
    scratch = scratch or Scratch(spark, "trie")
    rows = scratch.save(turns.select("conv_id", *order, "digest", "size"), "turns")
    placed = in_order(rows, "conv_id", order, scratch, "chain", "digest")
    chain = placed.select("conv_id", (F.col("_at") + 1).alias("depth"), F.col("_up").alias("up"), F.col("_key").alias("key"), "size")
    chain = scratch.save(chain.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "by-depth")

    # what one conversation alone reaches: nodes without regrouping
    reached = chain.groupBy("depth", "key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.min("up").alias("up"))
    single = scratch.save(reached.filter("n = 1").select("depth", "key", "up", "conv_id"), "single")
    entry = single.groupBy("conv_id").agg(F.min(F.struct("depth", "up")).alias("e"))
    entry = entry.select((F.col("e.depth") - 1).alias("depth"), F.col("e.up").alias("key"), "conv_id", F.lit(1).cast("bigint").alias("child"))
    tails = scratch.save(chain.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("t")).select("conv_id", "t.depth", "t.key"), "tails")
    silent = ids.join(tails, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(ROOT).alias("key"))
    ended = tails.join(single, ["conv_id", "depth"], "left_anti").select("conv_id", "depth", "key").unionByName(silent)
    ended = ended.select("depth", "key", "conv_id", F.lit(0).cast("bigint").alias("child"))
    entering = entry.unionByName(ended)
    entering = scratch.save(entering.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth"), "entering")

    whole = _NODES + ["parent_conv_id", "ends_sha256"]
    if not entering.limit(1).count():
        kinds = ["string" if c in ("key", "up", "ends_sha256") else "bigint" for c in whole]
        return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in zip(whole, kinds))).drop("up")
    _peel(entering, chain, scratch)
    shared = spark.read.parquet(scratch.path("nodes")).withColumn("depth", F.col("depth").cast("bigint")).select(*_NODES)

    digests = _end_digests(entering.filter("child = 0"), scratch)
    shared = shared.withColumn("_n", _node()).join(digests, F.col("_n") == F.col("_node"), "left")
    shared = scratch.save(shared.select(*_NODES, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")), "shared")
    last = tails.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"))
    alone = single.join(last, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
    ends_here = F.col("_c").isNotNull()
    one = F.lit(1).cast("bigint")
    alone = alone.select(
        "depth", "key", "up", "conv_id", one.alias("n_convs"), F.when(ends_here, 0).otherwise(1).cast("bigint").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.sha2(F.when(ends_here, F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"),
    )
    nodes = scratch.save(alone.unionByName(shared), "all")
    parents = shared.select(F.col("depth").alias("_d"), F.col("key").alias("_k"), F.col("conv_id").alias("_parent"))
    named = nodes.join(parents, (F.col("depth") - 1 == F.col("_d")) & (F.col("up") == F.col("_k")), "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id")).alias("parent_conv_id")
    return named.select(*[c for c in _NODES if c != "up"], parent, "ends_sha256")
