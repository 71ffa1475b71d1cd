"""Ordered funnels: the parallel fold and closed form against a literal sequential walk."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.operators.funnel import analyze_funnel
from logweave.sources.table import entries_from_table
from logweave.sources.text import LINE_ORDER, SPLIT_CHUNK, read_log_lines
from logweave.operators.parse import parse_entries
from logweave.specs import FunnelSpec, Step


def walk(step_sets, k, limit):
    """The automaton stated step by step, in both modes (limit 0 and limit != 0)."""
    counts, cur, conv = [0] * k, 0, 0
    if limit == 0:
        for steps in step_sets:
            if cur in steps:
                counts[cur] += 1
                cur += 1
                if cur >= k:
                    conv += 1
                    cur = 0
    else:
        for steps in step_sets:
            if conv >= limit:
                break
            if cur >= k:
                conv += 1
                cur = 0
                if conv >= limit:
                    break
            if cur in steps:
                counts[cur] += 1
                cur += 1
        if cur >= k:
            conv += 1
    return counts, conv


def funnel(*patterns, props=None):
    props = props or {}
    return FunnelSpec("f", tuple(Step(f"s{i}", p, props.get(i, {})) for i, p in enumerate(patterns)))


def steps_of(result):
    return [tuple(r) for r in result.steps().orderBy("step_index").collect()]


def drops_of(result):
    return [tuple(r) for r in result.drop_offs().orderBy("step_index").collect()]


def summary_of(result):
    return tuple(result.summary().first())


def run(entries_df, msgs, spec, limit=0, partitions=1):
    e = entries_df([(m, p) if isinstance(m, str) and p is not None else (m, None) for m, p in msgs], partitions)
    return analyze_funnel(e, spec, order_by=["seq"], limit=limit)


def plain(*msgs):
    return [(m, None) for m in msgs]


def test_empty_input_has_no_rows(entries_df, spark):
    e = entries_df(plain("x")).filter(F.lit(False))
    r = analyze_funnel(e, funnel("a", "b"), order_by=["seq"])
    assert steps_of(r) == [] and drops_of(r) == []
    assert summary_of(r)[:3] == ("f", 0, False)


def test_complete_incomplete_and_out_of_order(entries_df):
    r = run(entries_df, plain("login", "action", "logout"), funnel("login", "action", "logout"))
    assert [s[2] for s in steps_of(r)] == [1, 1, 1] and summary_of(r)[2] is True
    r = run(entries_df, plain("login", "noise", "action"), funnel("login", "action", "logout"))
    assert [s[2] for s in steps_of(r)] == [1, 1, 0] and summary_of(r)[2] is False
    r = run(entries_df, plain("logout", "action", "login"), funnel("login", "action", "logout"))
    assert [s[2] for s in steps_of(r)] == [1, 0, 0]
    assert drops_of(r) == [(1, "s0", "s1", 1, 100.0)]


def test_limit_one_of_two_rounds(entries_df):
    msgs = plain("e1", "e2", "e1", "e2")
    r = run(entries_df, msgs, funnel("e1", "e2"), limit=1)
    assert [s[2] for s in steps_of(r)] == [1, 1]
    assert summary_of(r)[:3] == ("f", 4, True)  # total counts every entry even when the walk stops
    r = run(entries_df, msgs, funnel("e1", "e2"), limit=-1)
    assert [s[2] for s in steps_of(r)] == [0, 0] and drops_of(r) == [] and summary_of(r)[2] is False


def test_drop_offs_and_percentages(entries_df):
    r = run(entries_df, plain("e1", "e2", "e1", "e2", "e3"), funnel("e1", "e2", "e3"))
    assert [s[2] for s in steps_of(r)] == [1, 1, 1]
    assert drops_of(r) == [(1, "s0", "s1", 0, 0.0), (2, "s1", "s2", 0, 0.0)]
    r = run(entries_df, plain("e1", "e2", "e1", "other"), funnel("e1", "e2"))
    assert [(s[2], s[3]) for s in steps_of(r)] == [(2, 100.0), (1, 50.0)]
    assert drops_of(r) == [(1, "s0", "s1", 1, 50.0)]


def test_subject_and_required_properties(entries_df):
    spec = funnel("view", "buy", props={0: {"user": "^u1"}})
    items = [
        ("x", '{"event": "view", "user": "u12"}'),   # match, property ok
        ("x", '{"event": "buy"}'),                   # step 2, no properties needed
        ("x", '{"event": "view", "user": "u2"}'),    # property mismatch
        ("x", '{"event": "view"}'),                  # property missing
        ("x", '{"event": "view", "user": 1}'),       # property not a string
        ("view", None),                              # no payload: property can never hold
        ("view", '{"user": "u1"}'),                  # no event key: message, property ok
        ("buy", None),
    ]
    r = run(entries_df, items, spec)
    assert [s[2] for s in steps_of(r)] == [2, 2]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_fold_matches_sequential_walk(spark, seed):
    rng = random.Random(seed)
    k = rng.randint(1, 8)
    letters = "abcdefgh"[: k + 2]
    n = rng.randint(0, 3000)
    msgs = ["".join(sorted(set(rng.choice(letters) for _ in range(rng.randint(0, 3))))) for _ in range(n)]
    step_patterns = [letters[i] if rng.random() < 0.7 else f"[{letters[i]}{letters[(i + 1) % len(letters)]}]"
                     for i in range(k)]
    import re

    sets = [{i for i, p in enumerate(step_patterns) if re.search(p, m)} for m in msgs]
    rows = [(i, m) for i, m in enumerate(msgs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq bigint, message string").repartition(rng.randint(1, 6))
    from logweave.sources.table import entries_from_table

    entries = entries_from_table(df, message="message", keep=["seq"])
    spec = FunnelSpec("f", tuple(Step(f"s{i}", p) for i, p in enumerate(step_patterns)))
    progress = analyze_funnel(entries, spec, order_by=["seq"]).progress.cache()
    for limit in (0, 1, 2, -1, 10**9):
        r = analyze_funnel(entries, spec, order_by=["seq"], limit=limit)
        r.progress = progress
        counts, conv = walk(sets, k, limit)
        got = steps_of(r)
        if n == 0:
            assert got == []
            continue
        assert [g[2] for g in got] == counts, (limit, step_patterns)
        assert summary_of(r)[1:4] == (n, conv > 0, conv)
    progress.unpersist()


def test_text_log_walks_splits_without_shuffle(spark, tmp_path):
    rng = random.Random(7)
    words = ["view", "click", "buy", "noise"]
    msgs = [rng.choice(words) for _ in range(5000)]
    for part in range(3):
        chunk = msgs[part * 2000 : (part + 1) * 2000]
        (tmp_path / f"part-{part}.log").write_text("".join(f"{m} {i}\n" for i, m in enumerate(chunk)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        entries = parse_entries(read_log_lines(spark, str(tmp_path)))
        spec = funnel("view", "click", "buy")
        r = analyze_funnel(entries, spec, order_by=LINE_ORDER, chunk_by=SPLIT_CHUNK)
        got = [s[2] for s in steps_of(r)]
        plan = r.progress._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    counts, _ = walk([{0} if m == "view" else {1} if m == "click" else {2} if m == "buy" else set() for m in msgs], 3, 0)
    assert got == counts
    assert "rangepartitioning" not in plan.lower()


def test_fold_levels_give_the_same_result(spark, monkeypatch):
    from logweave.operators import fold

    rng = random.Random(11)
    msgs = [rng.choice(["a", "b", "c", "ab", ""]) for _ in range(4000)]
    rows = [(i, m) for i, m in enumerate(msgs)]
    from logweave.sources.table import entries_from_table

    df = spark.createDataFrame(rows, "seq bigint, message string").repartition(5)
    entries = entries_from_table(df, message="message", keep=["seq"])
    spec = funnel("a", "b", "c")
    expected = [s[2] for s in steps_of(analyze_funnel(entries, spec, order_by=["seq"]))]
    monkeypatch.setattr(fold, "FAN_IN", 2)
    monkeypatch.setattr(fold, "GROUP", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = [s[2] for s in steps_of(analyze_funnel(entries, spec, order_by=["seq"]))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sets = [{i for i, p in enumerate("abc") if p in m} for m in msgs]
    assert got == expected == walk(sets, 3, 0)[0]


def test_shuffled_text_chunks_fail_loudly(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"{'ab'[i % 2]}\n" for i in range(3000)))
    lines = read_log_lines(spark, str(tmp_path)).repartition(3)
    entries = parse_entries(lines)
    r = analyze_funnel(entries, funnel("a", "b"), order_by=LINE_ORDER, chunk_by=SPLIT_CHUNK)
    with pytest.raises(Exception, match="split across tasks"):
        r.progress.collect()


def test_shuffled_text_chunks_fail_loudly_in_levels(spark, tmp_path, monkeypatch):
    from logweave.operators import fold

    monkeypatch.setattr(fold, "FAN_IN", 1)
    (tmp_path / "x.log").write_text("".join(f"{'ab'[i % 2]}\n" for i in range(3000)))
    entries = parse_entries(read_log_lines(spark, str(tmp_path)).repartition(3))
    r = analyze_funnel(entries, funnel("a", "b"), order_by=LINE_ORDER, chunk_by=SPLIT_CHUNK)
    with pytest.raises(Exception, match="split across tasks"):
        r.progress.collect()


def test_table_funnel_reads_its_input_once_and_ranges_what_it_wrote(spark):
    from logweave.sources.table import entries_from_table

    rng = random.Random(13)
    msgs = [rng.choice(["a", "b", "c", "ab", "x"]) for _ in range(3000)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "seq bigint, message string").repartition(6)
    entries = entries_from_table(df.mapInPandas(count, "seq bigint, message string"), message="message", keep=["seq"])
    # more post-shuffle partitions than spark.sql.shuffle.partitions must not change the number of runs
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "64")
    try:
        r = analyze_funnel(entries, funnel("a", "b", "c"), order_by=["seq"])
        plan = r.progress._jdf.queryExecution().executedPlan().toString()
        got = [s[2] for s in steps_of(r)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    sets = [{i for i, p in enumerate("abc") if p in m} for m in msgs]
    assert got == walk(sets, 3, 0)[0]
    assert seen.value == len(msgs)
    assert "rangepartitioning(seq" in plan and ", 4)" in plan
    assert any("logweave-funnel-" in f for f in r.progress.inputFiles())


def test_more_than_63_steps_use_two_mask_words(spark):
    from logweave.sources.table import entries_from_table

    rng = random.Random(21)
    k = 70
    msgs = [f"e{rng.randrange(k)}x" for _ in range(6000)]  # "x" ends the number, so e1 does not match e10
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "seq bigint, message string").repartition(3)
    entries = entries_from_table(df, message="message", keep=["seq"])
    spec = FunnelSpec("long", tuple(Step(f"s{i}", f"^e{i}x$") for i in range(k)))
    r = analyze_funnel(entries, spec, order_by=["seq"])
    sets = [{int(m[1:-1])} for m in msgs]
    counts, conv = walk(sets, k, 0)
    assert [s[2] for s in steps_of(r)] == counts
    assert summary_of(r)[3] == conv


# -- one walk per key ------------------------------------------------------------------------
def test_keyed_walks_match_a_walk_per_key(spark):
    """One key holds most entries, so its walk spans many ranges; null is a key; entries of all keys are interleaved."""
    rng = random.Random(31)
    spec = FunnelSpec("k", tuple(Step(f"s{i}", p) for i, p in enumerate(["a", "b", "[ab]c", "a"])))
    rows = [(rng.choice(["hot"] * 8 + [None, "x", "y", "é"]), rng.choice(["p", None]), i, rng.choice(["a", "b", "ac", "bc", "d", "ab"])) for i in range(6000)]
    rows += [("quiet", "p", 9000, "d")]
    df = spark.createDataFrame(rows, "who string, app string, seq bigint, m string").repartition(5)
    entries = entries_from_table(df, message="m", keep=["who", "app", "seq"])
    for limit in (0, 7, -1):
        got = analyze_funnel(entries, spec, order_by=["seq"], partition_by=["who", "app"], limit=limit)
        want = {}
        for who, app, _, m in sorted(rows, key=lambda r: r[2]):
            want.setdefault((who, app), []).append({i for i, p in enumerate(["a", "b", "[ab]c", "a"]) if re.search(p, m)})
        steps = {}
        for r in got.steps().collect():
            steps.setdefault((r.who, r.app), {})[r.step_index] = r.event_count
        assert {k: [v[i] for i in sorted(v)] for k, v in steps.items()} == {k: walk(v, 4, limit)[0] for k, v in want.items()}
        totals = {(r.who, r.app): (r.total_events_analyzed, r.conversions) for r in got.summary().collect()}
        assert totals == {k: (len(v), walk(v, 4, limit)[1]) for k, v in want.items()}


def test_hot_key_lies_in_many_ranges(spark):
    from logweave.operators.fold import _summaries, range_count
    from logweave.operators.funnel import step_mask_columns

    df = spark.range(4000).selectExpr("if(id % 10 < 9, 'hot', 'other') AS who", "id AS seq", "'a' AS m")
    masked, words, bits = step_mask_columns(entries_from_table(df, message="m", keep=["who", "seq"]), funnel("a", "b"), ["who", "seq"])
    cols = ["who", "seq"]
    arranged = masked.repartitionByRange(range_count(masked), *cols).sortWithinPartitions(*cols).withColumn("_run", F.spark_partition_id())
    runs = _summaries(arranged, bits, ["who", "_run"], words, keyed=True).collect()
    assert sum(r.who == "hot" for r in runs) >= 3 and max(r.rows for r in runs) < 2500


def test_keyed_walks_of_no_entries_and_refused_arguments(spark, entries_df):
    e = entries_df(plain("x")).filter(F.lit(False)).withColumn("who", F.lit("u"))
    r = analyze_funnel(e, funnel("a"), order_by=["seq"], partition_by=["who"])
    assert r.steps().count() == r.drop_offs().count() == r.summary().count() == 0
    for settings in ({"partition_by": ["who"], "chunk_by": ["seq"]}, {"partition_by": ["matches"]}):
        with pytest.raises(ValueError):
            analyze_funnel(e, funnel("a"), order_by=["seq"], **settings)
    with pytest.raises(ValueError):
        r.report()


def test_equal_steps_are_searched_once(entries_df):
    from logweave.operators.funnel import step_mask_columns

    spec = FunnelSpec("f", tuple(Step(f"s{i}", p, props) for i, (p, props) in enumerate([("a", {}), ("b", {}), ("a", {}), ("a", {"k": "v"}), ("b", {})])))
    masked, words, bits = step_mask_columns(entries_df(plain("a", "b", "ab")), spec, ["seq"])
    assert bits == [0, 1, 0, 2, 1] and [r[0] for r in masked.orderBy("seq").select(*words).collect()] == [1, 2, 3]
