"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

__all__ = ["WORD", "WHITE", "Scratch", "table", "word_count", "text_hash", "training_texts"]

# A word is a run of characters other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def word_count(text: Column) -> Column:
    """Number of words of ``text`` (null: 0) as BIGINT, without leaving the JVM."""
    parts = F.split(text, WHITE, -1)
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.coalesce(F.greatest(F.size(parts) - edges, F.lit(0)), F.lit(0)).cast("bigint")


def text_hash(text: Column) -> Column:
    """64-bit hash of a text; tells the texts of repeated ids apart (null has its own value)."""
    return F.xxhash64(text)


def training_texts(docs: DataFrame, known: DataFrame, most: int, seed: int) -> DataFrame:
    """``_id, label, turn, text``: at most ``most`` rows of ``docs[doc_id, text]`` for the ids of ``known[doc_id, label]``.

    The ids whose hash comes first are taken; hashes that are far behind are left out before the ids are ranked.  Of
    texts that share an id the one with the smallest hash stands, so an id of many rows is one row."""
    turn = F.xxhash64(F.lit(seed), "doc_id")
    share = min(1.0, (2 * most + 100) / max(1, known.count()))
    near = known.select(F.col("doc_id").alias("_id"), "label", turn.alias("turn")).filter(F.pmod("turn", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = near.orderBy(F.pmod("turn", F.lit(1 << 30)), "turn").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # `most` rows are broadcast
    return rows.groupBy("_id", "label", "turn").agg(F.min_by("text", text_hash(F.col("text"))).alias("text"))
