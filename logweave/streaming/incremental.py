"""Streaming variants of the count and the funnel.

* ``read_log_stream``: new text files in a directory, with the same order
  columns as ``read_log_lines``.
* ``count_patterns_stream``: ``count_patterns`` is one global aggregation, so it
  runs unchanged as a streaming aggregation (output mode ``complete``).
* ``FunnelStream``: the walk continues across micro-batches.  Each batch is
  reduced with the parallel fold to its full summary (``adv`` for every start
  state, plus its entry count), composed with the state before it, and stored as one row.
  Writing a batch's state is idempotent (overwrite of its own folder), so a
  replayed batch after a failure does not count twice, and no state lives only in memory.

Files are walked in path order within a batch and batches in arrival order,
so new files must sort after the ones already processed (rotated names with
timestamps do).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_one_cr
from ..operators.count import count_patterns
from ..operators.fold import compose_runs, walk
from ..operators.funnel import FunnelResult, step_mask_columns
from ..operators.parse import parse_entries
from ..session import Scratch
from ..sources.text import LINE_ORDER, SPLIT_CHUNK
from ..specs import FunnelSpec, ParserSpec

__all__ = ["read_log_stream", "with_line_pos", "count_patterns_stream", "FunnelStream"]


def read_log_stream(spark: SparkSession, path: str, *, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``DataFrame[value, file_path, block_start]`` of new files under ``path``.

    The in-split position ``pos`` is added per micro-batch (``with_line_pos``),
    because row ids are not available on streaming plans."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.text(path)
    return df.select(
        strip_one_cr(F.col("value")).alias("value"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def with_line_pos(batch: DataFrame) -> DataFrame:
    """Add ``pos`` to a micro-batch of ``read_log_stream`` (its scan keeps line order per split)."""
    if "pos" in batch.columns:
        return batch
    return batch.withColumn("pos", F.monotonically_increasing_id())


def count_patterns_stream(entries: DataFrame, patterns, *, with_rates: bool = False) -> DataFrame:
    """Running pattern counts of a streaming entry DataFrame (write with ``outputMode("complete")``)."""
    return count_patterns(entries, patterns, with_rates=with_rates)


class FunnelStream:
    """A funnel that keeps walking as log files arrive.

    ``state_path`` is a folder in shared storage (e.g. under
    ``spark.checkpoint.dir``).  The state after a micro-batch is one row: ``adv`` for every
    start state, composed over all batches so far, and the entry counts.  The two
    latest states are kept, so the last batch can be replayed.
    Use ``process_batch`` with ``foreachBatch`` (or ``start``), and
    ``result()`` for the step / drop-off / summary tables so far.
    """

    def __init__(self, spec: FunnelSpec, parser: ParserSpec, state_path: str):
        self.spec = spec
        self.parser = parser
        self.state_path = state_path

    def batch_summary(self, lines: DataFrame, scratch: Scratch) -> tuple[list[int], int, int]:
        """(adv, matching entries, entries) of a static batch of log lines."""
        entries = parse_entries(with_line_pos(lines), self.parser)
        masked, words, bits = step_mask_columns(entries, self.spec, list(LINE_ORDER))
        summaries, run_cols, total = walk(masked, bits, words, LINE_ORDER, SPLIT_CHUNK, scratch)
        row = compose_runs(summaries, run_cols, self.spec.k).first()  # k numbers
        return row["adv"], row["rows"], total

    def process_batch(self, lines: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` callback: store the state after this batch (a replayed batch writes the same)."""
        spark = lines.sparkSession
        scratch = Scratch(spark, "stream")
        adv, rows, total = self.batch_summary(lines, scratch)
        scratch.close()
        k, ids = self.spec.k, self._stored(spark)
        earlier = [i for i in ids if i < batch_id]
        before = self._read(spark, max(earlier)) if earlier else {"adv": [0] * k, "rows": 0, "total": 0}
        adv = [m + adv[(s + m) % k] for s, m in enumerate(before["adv"])]
        state = spark.createDataFrame(
            [(adv, before["rows"] + rows, before["total"] + total)], "adv array<bigint>, rows bigint, total bigint"
        )
        state.coalesce(1).write.mode("overwrite").parquet(self._folder(batch_id))
        for old in earlier:
            if old != max(earlier):
                self._files(spark).delete(self._path(spark, self._folder(old)), True)

    def start(self, lines_stream: DataFrame, checkpoint: str, **trigger):
        writer = lines_stream.writeStream.foreachBatch(self.process_batch).option("checkpointLocation", checkpoint)
        if trigger:
            writer = writer.trigger(**trigger)
        return writer.start()

    def progress(self, spark: SparkSession) -> DataFrame:
        """One row ``(total_events_analyzed, matches)`` over all batches so far."""
        ids = self._stored(spark)
        if not ids:
            return spark.range(1).select(F.lit(0).cast("bigint").alias("total_events_analyzed"), F.lit(0).cast("bigint").alias("matches"))
        state = spark.read.parquet(self._folder(max(ids)))
        return state.select(F.col("total").alias("total_events_analyzed"), F.col("adv")[0].alias("matches"))

    def result(self, spark: SparkSession, limit: int = 0) -> FunnelResult:
        return FunnelResult(self.progress(spark), self.spec, limit)

    # -- the state folder ------------------------------------------------------------
    def _folder(self, batch_id: int) -> str:
        return f"{self.state_path.rstrip('/')}/batch_id={batch_id}"

    @staticmethod
    def _path(spark, path: str):
        return spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, spark):
        return self._path(spark, self.state_path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _stored(self, spark) -> list[int]:
        """Ids of the batches whose state was written completely."""
        files, root = self._files(spark), self._path(spark, self.state_path)
        if not files.exists(root):
            return []
        names = [s.getPath() for s in files.listStatus(root)]
        done = [p.getName() for p in names if files.exists(self._path(spark, f"{p.toString()}/_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in done if n.startswith("batch_id="))

    def _read(self, spark, batch_id: int):
        return spark.read.parquet(self._folder(batch_id)).first()
