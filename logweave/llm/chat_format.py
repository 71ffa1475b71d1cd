"""Chat formatting of reply trees.

A conversation is a tree of turns (``conv_id, node_id, parent_id, role, text, score``).
Its root-to-leaf paths are found by iterative self-joins that double their reach: round
k joins every turn with its ancestor 2^k steps up, carrying the score and the number of
turns in between, so a path of n turns takes log2(n) joins.  Leaves are
ranked by the mean score of their path; the best ``max_paths`` of each
conversation are formatted, each as one conversation.  Their turns come from the same jump tables: a leaf's
ancestors at all distances are the closure of its jumps.

The format marks turns as ``<|im_start|>role``, a line feed, the text and ``<|im_end|>``, a line
feed.  Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``
(in roles a line feed becomes ``\\n`` too), so no control string can come from a text
and every text can be read back.  The loss mask lists the spans, in code points, of the
escaped assistant texts.

Defined results: null roles and texts are empty; a parent that is null or unknown makes a root; of several rows with one
node id the first by (parent, role, text) stands; turns on or below a cycle have no root and
are on no path; equal scores go to the longer path, then to the smaller leaf id; a
null conv_id is a conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["escape", "unescape", "format_turns", "read_back", "best_paths", "format_conversations", "chain", "digests"]

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str, line: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("\n", "\\n") if line else out


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turns(turns) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of the assistant texts in it) of (role, text) pairs."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role, line=True)}\n", escape(text)
        parts += [head, body, f"{END}\n"]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def chain(rows: DataFrame, order: str = "turn") -> DataFrame:
    """Plain conversations ``conv_id, <order>, role, text`` as trees without branches.

    Turns are numbered in the order of (``order``, role, text), so repeated turns keep their place."""
    turn = Window.partitionBy("conv_id").orderBy(F.col(order).asc_nulls_first(), "role", "text")
    n = F.row_number().over(turn).cast("bigint")
    tree = rows.select("conv_id", n.alias("node_id"), "role", "text")
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return tree.select("conv_id", "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def best_paths(tree: DataFrame, scratch: Scratch, max_paths: int = 1) -> DataFrame:
    """``conv_id, path INT, depth BIGINT, role, text``: the turns of each conversation's best paths."""
    one = Window.partitionBy("conv_id", "node_id").orderBy(F.col("parent_id").asc_nulls_first(), "role", "text")
    nodes = tree.select(
        "conv_id", "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    nodes = nodes.filter(F.col("node_id").isNotNull()).withColumn("_row", F.row_number().over(one)).filter("_row = 1").drop("_row")
    known = nodes.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_p"))
    nodes = scratch.save(
        nodes.join(known, _same("conv_id", "_c") & (F.col("parent_id") == F.col("_p")), "left")
        .select("conv_id", "node_id", F.col("_p").alias("parent_id"), "role", "text", "score"),
        "nodes",
    )
    # jump k: the ancestor 2^k turns up, the score and the number of turns passed (the turn itself included);
    # a turn whose jump has left the tree is done, and only the others are joined again
    jump = nodes.select("conv_id", "node_id", F.col("parent_id").alias("up"), F.col("score").alias("sum"), F.lit(1).cast("bigint").alias("turns"))
    total = nodes.count()
    jumps = [scratch.save(jump, "jump-0")]
    while (1 << (len(jumps) - 1)) <= total and jumps[-1].filter(F.col("up").isNotNull()).limit(1).count():
        last = jumps[-1]
        far = last.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), F.col("up").alias("_up"), F.col("sum").alias("_s"), F.col("turns").alias("_t"))
        met = last.filter(F.col("up").isNotNull()).join(far, _same("conv_id", "_c") & (F.col("up") == F.col("_n")))
        further = met.select(
            "conv_id", "node_id", F.col("_up").alias("up"), (F.col("sum") + F.col("_s")).alias("sum"), (F.col("turns") + F.col("_t")).alias("turns")
        )
        jumps.append(scratch.save(further.unionByName(last.filter(F.col("up").isNull())), f"jump-{len(jumps)}"))
    rooted = jumps[-1].filter(F.col("up").isNull())  # whoever still has an ancestor is caught in a cycle
    inner = nodes.filter(F.col("parent_id").isNotNull()).select(F.col("conv_id").alias("_c"), F.col("parent_id").alias("_p")).distinct()
    leaves = rooted.join(inner, _same("conv_id", "_c") & (F.col("node_id") == F.col("_p")), "left_anti")
    rank = Window.partitionBy("conv_id").orderBy((F.col("sum") / F.col("turns")).desc(), F.col("turns").desc(), "node_id")
    marked = leaves.withColumn("path", F.row_number().over(rank)).filter(F.col("path") <= max_paths).select("conv_id", "path", "node_id")
    for k, jump in enumerate(jumps):
        step = jump.filter(F.col("up").isNotNull()).select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), "up")
        further = marked.join(step, _same("conv_id", "_c") & (F.col("node_id") == F.col("_n"))).select("conv_id", "path", F.col("up").alias("node_id"))
        marked = scratch.save(marked.unionByName(further), f"marked-{k}")
        scratch.drop(f"marked-{k - 1}", *([f"jump-{k}"] if k < len(jumps) - 1 else []))
    depths = rooted.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), F.col("turns").alias("depth"))
    placed = marked.join(depths, _same("conv_id", "_c") & (F.col("node_id") == F.col("_n"))).drop("_c", "_n")
    words = nodes.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), "role", "text")
    return placed.join(words, _same("conv_id", "_c") & (F.col("node_id") == F.col("_n"))).select("conv_id", "path", "depth", "role", "text")


def _format_task(batches):
    for pdf in batches:
        made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in pdf["turns"]]
        yield pd.DataFrame({
            "conv_id": pdf["conv_id"], "path": pdf["path"], "formatted": [text for text, _ in made],
            "loss": [[{"start": a, "end": b} for a, b in spans] for _, spans in made],
        })


def format_conversations(tree: DataFrame, *, max_paths: int = 1) -> DataFrame:
    """``conv_id, path INT, formatted STRING, loss ARRAY<STRUCT<start, end>>``: one row per chosen path."""
    scratch = Scratch(tree.sparkSession, "chat")
    turns = best_paths(tree, scratch, max_paths)
    grouped = turns.groupBy("conv_id", "path").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    id_type = tree.schema["conv_id"].dataType.simpleString()
    return grouped.mapInPandas(_format_task, f"conv_id {id_type}, path int, formatted string, loss array<struct<start:bigint,end:bigint>>")


def _digest_task(batches):
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    for pdf in batches:
        out = []
        for conv_id, formatted, loss in zip(pdf["conv_id"], pdf["formatted"], pdf["loss"]):
            turns = read_back(formatted)
            learnt = "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((conv_id, len(turns), sha(said), len(learnt), sha(learnt), len(formatted)))
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(made: DataFrame) -> DataFrame:
    """What reading ``format_conversations`` rows back gives: counts and hashes of the turns and of the text under the loss mask."""
    id_type = made.schema["conv_id"].dataType.simpleString()
    return made.mapInPandas(
        _digest_task,
        f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
