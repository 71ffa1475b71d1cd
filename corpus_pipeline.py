"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on
all rows of ``docs`` and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, table
from logweave.llm.line_dedup import dedup_lines
from logweave.llm.mixing import mixed_documents
from logweave.llm.ngram_join import keep_one
from logweave.llm.packing import pack_pieces, token_pieces
from logweave.llm.quality_classifier import score_documents
from logweave.llm.queries import tokenizer_files

__all__ = ["STAGES", "ORACLE_SQL", "run"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier three-line window; ``n_chars`` follows the text."""
    new = {"n_chars": F.length("text").cast("bigint")}
    return dedup_lines(docs).select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word shingle similarity of 0.8 or more."""
    return keep_one(docs, k=5, threshold=(80, 100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents repeated and cut to the blocks it takes."""
    return mixed_documents(docs, weights=(5, 2, 1))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece with its sequence and place."""
    pieces = token_pieces(docs, *tokenizer_files(), end_id=0, capacity=2048)
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Training, hashing and tokenising are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = made if i == len(STAGES) - 1 else scratch.save(made, f"{i}-{name}")
    return docs
