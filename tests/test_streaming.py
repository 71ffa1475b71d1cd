"""Streaming count and funnel agree with the batch operators."""

import os
import random

from logweave.operators.funnel import analyze_funnel
from logweave.operators.parse import parse_entries
from logweave.sources.text import LINE_ORDER, SPLIT_CHUNK, read_log_lines
from logweave.specs import FunnelSpec, ParserSpec, Step
from logweave.streaming import FunnelStream, count_patterns_stream, read_log_stream


def write_files(folder, rng, n_files, per_file):
    words = ["view", "click", "buy", "noise"]
    for f in range(n_files):
        file = folder / f"log-{f:03d}.txt"
        file.write_text("".join(f"{rng.choice(words)} {i}\n" for i in range(per_file)))
        os.utime(file, (1_700_000_000 + f, 1_700_000_000 + f))  # files arrive in the order of their names


def test_funnel_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_files(src, random.Random(3), 6, 500)
    spec = FunnelSpec("f", (Step("a", "view"), Step("b", "click"), Step("c", "buy")))
    fs = FunnelStream(spec, ParserSpec(), str(tmp_path / "state"))
    q = fs.start(read_log_stream(spark, str(src), max_files_per_trigger=2), str(tmp_path / "ckpt"), availableNow=True)
    q.awaitTermination()
    streamed = [tuple(r) for r in fs.result(spark).steps().orderBy("step_index").collect()]
    entries = parse_entries(read_log_lines(spark, str(src)))
    batch = analyze_funnel(entries, spec, order_by=LINE_ORDER, chunk_by=SPLIT_CHUNK)
    assert streamed == [tuple(r) for r in batch.steps().orderBy("step_index").collect()]
    assert tuple(fs.result(spark).summary().first())[1] == 3000
    # replaying the last batch id overwrites its state instead of adding to it
    fs.process_batch(read_log_lines(spark, str(src / "log-000.txt")).limit(0), 2)
    assert tuple(fs.result(spark).summary().first())[1] == 2000  # batch 2 held two files


def test_count_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_files(src, random.Random(5), 3, 200)
    entries = parse_entries(read_log_stream(spark, str(src)))
    q = (count_patterns_stream(entries, ["view", "click"]).writeStream.outputMode("complete")
         .format("memory").queryName("counts_stream").trigger(availableNow=True).start())
    q.awaitTermination()
    got = [tuple(r) for r in spark.sql("SELECT * FROM counts_stream ORDER BY pattern_index").collect()]
    static = parse_entries(read_log_lines(spark, str(src)))
    from logweave.operators.count import count_patterns

    assert got == [tuple(r) for r in count_patterns(static, ["view", "click"]).orderBy("pattern_index").collect()]


def test_funnel_stream_keeps_two_states(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_files(src, random.Random(8), 5, 300)
    spec = FunnelSpec("f", (Step("a", "view"), Step("b", "click")))
    fs = FunnelStream(spec, ParserSpec(), str(tmp_path / "state"))
    assert tuple(fs.result(spark).summary().first())[1] == 0
    fs.start(read_log_stream(spark, str(src), max_files_per_trigger=1), str(tmp_path / "ckpt"), availableNow=True).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["batch_id=3", "batch_id=4"]
    assert tuple(fs.result(spark).summary().first())[1] == 1500
