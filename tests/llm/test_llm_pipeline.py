"""The pipeline and the registered queries."""

import os
from collections import Counter

import pytest
from brute import components, dedup, mix_targets, words

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from logweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_query_per_operator():
    qs = entry.queries()
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(QUERIES) <= set(qs) and qs["pipeline"] is pipeline.run and set(ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "mixing", "packing"]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_each_stage_against_brute_force(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    stages = [f for _, f in pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    kept = stages[0](spark, docs, SF)
    assert kept.columns == COLUMNS
    left = {d for d, _ in rows_of(kept)}
    assert all(d in left for d, q in labels.items() if q == 1)

    cut = stages[1](spark, kept, SF)
    assert cut.columns == COLUMNS
    got = Counter(rows_of(cut))
    assert got == Counter((d, t) for d, t, *_ in dedup(rows_of(kept)))
    assert all(r.n_chars == len(r.text) for r in cut.limit(50).collect())

    single = stages[2](spark, cut, SF)
    assert single.columns == COLUMNS
    comps = components(rows_of(cut), 5, 80, 100)
    assert sorted(d for d, _ in rows_of(single)) == sorted({d for d, _, c in comps if d == c})

    mixed = stages[3](spark, single, SF)
    assert mixed.columns == COLUMNS
    sizes, taken, whole = Counter(), Counter(), {}
    for r in single.collect():
        sizes[r.source] += len(words(r.text))
        whole[r.doc_id] = Counter(words(r.text))
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
        assert not Counter(words(r.text)) - whole[r.doc_id]
    want = mix_targets(dict(sizes), (5, 2, 1))
    assert all(abs(taken[s] - want[s]) <= 128 for s in sizes)

    packed = stages[4](spark, mixed, SF).collect()
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(m for _, m in pieces[:i]) for i in range(len(pieces))]
        assert sum(m for _, m in pieces) <= 2048
    assert len(bins) <= -(-sum(r.length for r in packed) // 2048) + 2


def test_stages_survive_awkward_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _doc string, score string"
    rows = [(i, f"some words of text number {i} " * 8 + f"\nline {i % 3}\nmore", "en", "a", 1, "x", "y") for i in range(12)]
    rows += [(None, None, None, None, None, None, None), (3, rows[3][1], "en", "a", 1, "x", "y"), (90, "", "en", None, 0, "x", "y"), (91, "w " * 30_000, "en", "b", 0, "x", "y")]
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for i, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < 4:
                assert out.columns == docs.columns
                path = str(tmp_path / f"{len(table)}-{i}")
                out.write.parquet(path)
                docs = spark.read.parquet(path)
            else:
                assert (out.count() > 0) == bool(table)
