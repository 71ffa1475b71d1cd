"""Pattern counts."""

from pyspark.sql import functions as F

from logweave.operators.count import count_patterns, count_summary


def counts(df):
    return [tuple(r) for r in df.orderBy("pattern_index").collect()]


def test_basic_counts_keep_argument_order_and_zero_counts(entries_df):
    e = entries_df([("login user_1", None), ("logout user_1", None), ("login user_2", None), ("ERROR disk", None)])
    assert counts(count_patterns(e, ["login", "logout", "error", r"user_\d+"])) == [
        (1, "login", 2), (2, "logout", 1), (3, "error", 0), (4, r"user_\d+", 3)]


def test_case_sensitive_and_unanchored(entries_df):
    e = entries_df([("Error", None), ("an error occurred", None)])
    assert counts(count_patterns(e, ["error", "(?i)error", "^error"])) == [
        (1, "error", 1), (2, "(?i)error", 2), (3, "^error", 0)]


def test_subject_rules(entries_df):
    e = entries_df([
        ("msg purchase", '{"event": "view"}'),   # event string wins over the message
        ("msg purchase", '{"event": 5}'),        # non-string event never matches
        ("msg purchase", '{"event": null}'),     # nor does JSON null
        ("msg purchase", '{"other": "view"}'),   # no event key: the message
        ("msg purchase", None),                  # no payload: the message
        ("msg purchase", "{}"),                  # empty payload: the message
    ])
    assert counts(count_patterns(e, ["view", "purchase"])) == [(1, "view", 1), (2, "purchase", 3)]


def test_empty_input_and_zero_patterns(spark, entries_df):
    empty = entries_df([("x", None)]).filter(F.lit(False))
    assert count_patterns(empty, ["x"]).count() == 0
    assert tuple(count_summary(empty, ["x"]).first()) == (0, 0)
    e = entries_df([("a", None), ("b", None)])
    assert count_patterns(e, []).count() == 0
    assert tuple(count_summary(e, []).first()) == (2, 0)


def test_thousand_entries_half_match(entries_df):
    e = entries_df([("even" if i % 2 == 0 else "odd", None) for i in range(1000)], partitions=4)
    assert counts(count_patterns(e, ["^even$"])) == [(1, "^even$", 500)]


def test_duplicates_rates_and_summary(entries_df):
    e = entries_df([("view", None), ("view", None), ("click", None), ("vim", None)])
    assert counts(count_patterns(e, ["view", "view", "^v"], with_rates=True)) == [
        (1, "view", 2, 50.0), (2, "view", 2, 50.0), (3, "^v", 3, 75.0)]
    assert tuple(count_summary(e, ["view", "view", "^v"]).first()) == (4, 7)


def test_patterns_with_classes_and_repeats(entries_df):
    e = entries_df([
        ("deploy v1.20.3 to web", None), ("deploy v2 to web", None), ("rollback to v0.9.11-rc1", None),
        ("read /var/log/app/x.log", None), ("read C:\\x.log", None), ("open /etc/hosts and /tmp/a", None),
        ("took 35ms", None), ("took 1.5s", None), ("took ages", None), ("job #4411 done in 2s", None),
    ])
    got = counts(count_patterns(e, [r"\bv\d+\.\d+\.\d+", r"(?:/[a-z.]+){2,}", r"\b\d+(?:\.\d+)?m?s\b", r"#\d{4,}"]))
    assert [n for _, _, n in got] == [2, 2, 3, 1]


def test_many_patterns_equal_the_patterns_one_by_one(spark, entries_df):
    """Beyond FEW patterns an automaton names what is searched; the counts do not change."""
    import random

    from logweave.functions.match import match_subject, matches_pattern
    from logweave.operators.count import FEW, pattern_totals

    rng = random.Random(4)
    pieces = ["ab", "ba", "é", "😀", "a.b", "a", "B", "\n", " ", "abab", "x1", "ſ", "K"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    e = entries_df([(t, rng.choice([None, '{"event": "ab"}', '{"event": 1}'])) for t in texts], partitions=3)
    patterns = [rng.choice(["", "^", "(?i)", r"\b"]) + p + rng.choice(["", "$", "+", r"\w*b", "|a1"]) for p in ["ab", "é", "😀", r"a\.b", "a.b", "abab", "k", "x[0-9]", "[^z]", "zz"] for _ in range(9)]
    assert len(patterns) > FEW
    subject = e.select(match_subject(F.col("message"), F.col("event_data")).alias("s"))
    want = subject.agg(*[F.count_if(matches_pattern(F.col("s"), p)).alias(f"c{i}") for i, p in enumerate(patterns)]).first()
    row = pattern_totals(e, patterns).first()
    assert row["counts"] == list(want) and row["total_events_analyzed"] == 300
    assert counts(count_patterns(e.filter("false"), patterns)) == []
    assert tuple(count_summary(e, patterns).first()) == (300, sum(want))
