"""Connected components of an edge table, by alternating large and small stars.

Each round rewires every edge towards the smallest known neighbour: the large
star hangs a node's larger neighbours on the smallest of its neighbourhood, the
small star does the same with its smaller ones.  The rounds, logarithmic in
practice, end when the edge table no longer changes; it is then one star per
component.  Every round is a few equi-joins and pre-aggregated group-bys on the edges,
written to the shared folder; the driver sees two numbers a round.  The centre of a large star is
a hot key: the minima are pre-aggregated before they move, and are written before they meet the edges again, so that
the join stands on two plain shuffles and adaptive execution may split the centre's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

__all__ = ["components"]


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
    met = both.join(scratch.save(least, name), F.col("a") == F.col("_a")).filter(F.col("b") > F.col("a"))
    return met.select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.save(down.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_a"), name)
    met = down.join(least, F.col("a") == F.col("_a"))
    hung = met.select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b")
    return hung.unionByName(least.select(F.col("_a").alias("a"), F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``node BIGINT, root BIGINT`` for every node of ``edges[a, b]`` (BIGINT, a <> b); root is the smallest node."""
    current = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    state, turn = _state(current), 0
    while state[0]:
        turn += 1
        large = scratch.save(_large_star(current, scratch, f"{label}-{turn}-above"), f"{label}-{turn}-large")
        following = scratch.save(_small_star(large, scratch, f"{label}-{turn}-below"), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}", *[f"{label}-{turn}-{step}" for step in ("above", "large", "below")])
        current, before, state = following, state, _state(following)
        if state == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
