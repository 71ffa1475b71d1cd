"""Text log scan.

Lines are read with Spark's text source (splittable, one task per file split)
and carry explicit order columns, because a DataFrame has no order of its own:
``file_path`` and ``block_start`` identify the split, ``pos`` (from
``monotonically_increasing_id``) increases with the line position inside a
split.  Sorting by ``LINE_ORDER`` restores file order; ``SPLIT_CHUNK`` is a
chunk key that is monotone in that order and never spans two tasks, which the
funnel uses to walk splits in parallel without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_one_cr

__all__ = ["read_log_lines", "LINE_ORDER", "SPLIT_CHUNK"]

LINE_ORDER = ("file_path", "block_start", "pos")
SPLIT_CHUNK = ("file_path", "block_start")


def read_log_lines(spark: SparkSession, paths) -> DataFrame:
    """``DataFrame[value STRING, file_path STRING, block_start BIGINT, pos BIGINT]``.

    Lines end at ``\\n`` only (a lone ``\\r`` does not break a line) and one
    trailing ``\\r`` is dropped, so CRLF files read like LF files.  ``paths`` is
    a path, a glob or a list of them; files are ordered by path.
    """
    if isinstance(paths, str):
        paths = [paths]
    df = spark.read.option("lineSep", "\n").text(list(paths))
    return df.select(
        strip_one_cr(F.col("value")).alias("value"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("pos"),
    )
