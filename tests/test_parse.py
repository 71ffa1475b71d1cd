"""Line parsing: positional groups, message rule, timestamps, payloads, blank lines."""

import re

import pytest
from pyspark.sql import functions as F

from logweave.functions.payload import string_prop
from logweave.operators.parse import parse_entries, parse_stats
from logweave.sources.text import LINE_ORDER, read_log_lines
from logweave.specs import ParserSpec, pattern_guard

SIX_FIELDS = r"^(\d\d/\d\d \d\d:\d\d:\d\d\.\d{3}) \[(\d+):(\d+)\] ([A-Z]) ([\w ]+) - (.*)$"
SIX_SPEC = ParserSpec(timestamp_format="MM/dd HH:mm:ss.SSS", event_regex=r"metrics - (.*)", json_extraction=True,
                      log_line_regex=SIX_FIELDS)


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("line_no").select(*cols).collect()]


def test_default_parser_is_whole_trimmed_line(lines_df):
    df = parse_entries(lines_df(["  signin account_7 ", "", " \t ", "checkout ", "　x"]))
    assert rows(df, "message", "level", "tag", "pid", "tid") == [
        ("signin account_7", "", "", 0, 0), ("checkout", "", "", 0, 0), ("x", "", "", 0, 0)]
    assert df.select("ts").distinct().collect()[0][0] is None
    assert df.select(F.col("event_data").isNull()).distinct().collect()[0][0] is True


def test_six_fields_and_json_payload(lines_df):
    lines = [
        '03/04 08:01:02.500 [77:78] D metrics - {"event": "open", "account": "a7", "n": 5}',
        "03/04 08:01:03.250 [77:79] I metrics - Event open for account_7",
        "not a line of that layout",
        '02/29 23:59:59.999 [1:2] W Tag with space - {"event": 5}',
    ]
    df = parse_entries(lines_df(lines), SIX_SPEC)
    got = rows(
        df, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), "pid", "tid", "level", "tag", "message",
        string_prop(F.col("event_data"), "event"), string_prop(F.col("event_data"), "account"),
        F.col("event_data").isNull(),
    )
    assert got == [
        ("2000-03-04 08:01:02.500", 77, 78, "D", "metrics", '{"event": "open", "account": "a7", "n": 5}', "open", "a7", False),
        ("2000-03-04 08:01:03.250", 77, 79, "I", "metrics", "Event open for account_7", None, None, True),
        ("2000-02-29 23:59:59.999", 1, 2, "W", "Tag with space", '{"event": 5}', None, None, False),
    ]


def test_three_groups_are_positional(lines_df):
    # groups: 1 timestamp, 2 -> pid (not a number: 0), 3 -> tid (0); message is the last group
    spec = ParserSpec(timestamp_format="HH:mm:ss", log_line_regex=r"^<(\S+)> (\w+) = (.*)$")
    df = parse_entries(lines_df(["<08:01:02> WARN = Basket [add] item_9 by account_7", "<08:01:03> INFO = 42"]), spec)
    assert rows(df, "level", "tag", "pid", "tid", "message", F.date_format("ts", "HH:mm:ss")) == [
        ("", "", 0, 0, "Basket [add] item_9 by account_7", "08:01:02"), ("", "", 0, 42, "42", "08:01:03")]


def test_timestamp_group_without_format_is_ignored(lines_df):
    df = parse_entries(lines_df(["2024-03-04 08:01:02 something happened"]),
                       ParserSpec(log_line_regex=r"^(\S+ \S+) (.*)$"))
    assert rows(df, "message", "ts") == [("something happened", None)]


def test_bad_timestamp_becomes_message(lines_df):
    spec = ParserSpec(timestamp_format="HH:mm:ss", log_line_regex=r"^(\S+) (.*)$")
    df = parse_entries(lines_df(["99:99:99 late", "08:00:00 fine"]), spec)
    assert rows(df, "message", "pid") == [("99:99:99", 0), ("fine", 0)]


def test_message_group_six_wins_and_last_group_fallback(lines_df):
    seven = ParserSpec(log_line_regex=r"^(a)?(b)?(c)?(d)?(e)?(f)?(g)?$")
    df = parse_entries(lines_df(["abcdefg", "abcdeg", "abcdef"]), seven)
    # g6 non-empty -> g6; g6 empty -> the last group (g7), which may be empty
    assert rows(df, "message", "level", "tag") == [("f", "d", "e"), ("g", "d", "e"), ("f", "d", "e")]
    nogroups = parse_entries(lines_df(["anything"]), ParserSpec(log_line_regex="any"))
    assert rows(nogroups, "message") == [("",)]


def test_pid_parse_is_strict(lines_df):
    spec = ParserSpec(log_line_regex=r"^(\S*) (\S*) (\S*) (.*)$")
    df = parse_entries(lines_df(["t +5 -7 m", "t 5.0 x m", "t 99999999999999999999 08 m"]), spec)
    assert rows(df, "pid", "tid") == [(5, -7), (0, 0), (0, 8)]


def test_json_rules(lines_df):
    spec = ParserSpec(json_extraction=True, event_regex=r"payload=(.*)")
    lines = [
        'payload={"event": "a"}',                 # object
        "payload=null",                           # JSON null: payload NULL, no fallback
        'payload=[1, 2]',                         # array: not an object
        'payload={"event": "a"} trailing',        # trailing text: not one value
        'payload={"a":1}] {"b":2}',               # closes early
        'payload={"event": "x", "event": "y"}',   # duplicate key: last wins
        "payload={}",                             # empty object: present
        'payload=  {"k": "v"}  ',                 # surrounding white space is trimmed
        '{"event": "from message"}',              # no payload match: the message itself
        "payload=notjson",                        # falls back to message, which is not JSON
    ]
    df = parse_entries(lines_df(lines), spec)
    got = rows(df, F.col("event_data").isNull(), string_prop(F.col("event_data"), "event"),
               F.size(F.map_keys("event_data")))
    assert got == [
        (False, "a", 1), (True, None, None), (True, None, None), (True, None, None), (True, None, None),
        (False, "y", 1), (False, None, 0), (False, None, 1), (False, "from message", 1), (True, None, None),
    ]


def test_json_extraction_off(lines_df):
    df = parse_entries(lines_df(['{"event": "a"}']), ParserSpec(json_extraction=False))
    assert rows(df, F.col("event_data").isNull()) == [(True,)]


def test_event_regex_sees_the_raw_line(lines_df):
    # the raw line keeps its leading spaces, the trimmed line does not
    spec = ParserSpec(json_extraction=True, event_regex=r'^  (\{.*\})$', log_line_regex=r"^(\{.*)$")
    df = parse_entries(lines_df(['  {"event": "raw"}']), spec)
    assert rows(df, string_prop(F.col("event_data"), "event")) == [("raw",)]


def test_parse_stats(lines_df):
    spec = ParserSpec(log_line_regex=r"^[A-Z](.*)$")
    df = parse_stats(lines_df(["Alpha", "beta", "", "   ", "Gamma", "delta"]), spec)
    assert tuple(df.first()) == (6, 2, 2)


def test_text_source_order_crlf_and_splits(spark, tmp_path):
    a = tmp_path / "a.log"
    a.write_bytes(b"first\r\nsecond\rstill second\n\nthird")
    b = tmp_path / "b.log"
    b.write_bytes("".join(f"line {i}\n" for i in range(2000)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_log_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 2
        got = [r.value for r in lines.orderBy(*LINE_ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[:4] == ["first", "second\rstill second", "", "third"]
    assert got[4:] == [f"line {i}" for i in range(2000)]


def test_wall_clock_text_ignores_the_session_zone(spark):
    from logweave.functions.clock import wall_clock_text

    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:07.123456' AS ts, CAST(NULL AS timestamp_ntz) AS n")
        row = df.select(wall_clock_text("ts", "yyyy-MM-dd HH:mm:ss.SSS"), wall_clock_text("n", "HH:mm")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == ("2024-03-10 02:30:07.123", None)


def test_filters_on_parsed_entries_keep_their_meaning(lines_df):
    lines = [
        '03/04 08:01:02.500 [77:78] D metrics - {"event": "open", "account": "a7"}',
        "03/04 08:01:03.250 [77:79] I metrics - Event open for account_7",
        '03/04 08:01:04.000 [12:13] W metrics - {"event": "close", "account": "b1"}',
        "bad line",
    ]
    e = parse_entries(lines_df(lines), SIX_SPEC)
    everything = {r.line_no: r for r in e.collect()}
    expected = sorted(n for n, r in everything.items() if r.event_data is not None and r.pid == 77)
    got = sorted(r.line_no for r in e.filter(F.col("event_data").isNotNull() & (F.col("pid") == 77)).collect())
    assert got == expected == [0]
    msg = sorted(r.line_no for r in e.filter(F.col("message").contains("open")).collect())
    assert msg == [0, 1]


# Line formats and layouts published for Android logs and for plain structured logs.
PUBLISHED = [
    (r"^(\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\s+(\d+)\s+(\d+)\s+([VDIWEFS])\s+([^:]+):\s*(.*)$", "01-02 15:04:05.000",
     "03-04 08:01:02.500  77  78 D Tag: text", ("2000-03-04 08:01:02.5", 77, 78, "D", "Tag", "text")),
    (r"^(\d{2}:\d{2}:\d{2})\s+([A-Z]+)\s+(.*)$", "15:04:05", "08:01:02 WARN text", ("2000-01-01 08:01:02", 0, 0, "", "", "text")),
]


def test_published_configurations_parse(lines_df):
    for regex, layout, line, expected in PUBLISHED:
        spec = ParserSpec.from_config({"timestamp_format": layout, "log_line_regex": regex})
        df = parse_entries(lines_df([line]), spec)
        assert rows(df, F.col("ts").cast("string"), "pid", "tid", "level", "tag", "message") == [expected]


def test_deep_regexes_parse_like_any_other(lines_df):
    # alternatives inside a repeated group: evaluated by RE2, groups, payload and filter alike
    spec = ParserSpec(json_extraction=True, event_regex=r"(?:x|y)*=(\{.*\})", log_line_regex=r"^((?:a|bc)+) (\d+)(?: (\w+))? ?(.*)$")
    long = "abc" * 100_000
    df = parse_entries(lines_df([f"{long} 7 word rest", 'abca 8 xyx={"event": "e"}', "c 9", "a 5"]), spec)
    assert rows(df, F.length("message"), "pid", "tid", string_prop(F.col("event_data"), "event")) == [
        (4, 7, 0, None), (15, 8, 0, "e"), (0, 5, 0, None)]
    assert tuple(parse_stats(lines_df([long + " 1", "zzz", ""]), spec).first()) == (3, 1, 1)


def test_counters_come_with_the_pass_that_reads_the_entries(spark, lines_df):
    from pyspark.sql import Observation

    from logweave.operators.count import count_patterns
    from logweave.operators.funnel import analyze_funnel
    from logweave.specs import FunnelSpec

    lines = lines_df(["a 1", "", "  ", "b 2", "no", "a 3", "\u00a0"])
    spec = ParserSpec(log_line_regex=r"^([ab]) (\d)$")
    want = parse_stats(lines, spec).first().asDict()
    assert want == {"total_lines": 7, "parsed_entries": 3, "skipped_lines": 1}
    for run in (
        lambda e: count_patterns(e, ["1", "3"]).collect(),
        lambda e: analyze_funnel(e, FunnelSpec.of("f", "1", "3"), order_by=["line_no"]).steps(),  # the pass runs when the funnel is built
    ):
        stats = Observation()
        run(parse_entries(lines, spec, stats=stats))
        assert stats.get == want
    assert [r.message for r in parse_entries(lines, spec, stats=Observation()).collect()] == ["1", "2", "3"]


@pytest.mark.parametrize(
    "pattern,good,bad",
    [
        ("HH:mm:ss.SSS", ["08:01:02.500"], ["08:01:02.5", "08:01:02.50", "08:01:02.5000", "8:01:02.500", "08:01:02"]),
        ("H:mm[:ss]", ["8:01", "18:01:05"], ["8:1", "118:01", "8:01:5"]),
        ("yyyyMMdd'T'HHmmss", ["20240304T080102"], ["2024034T080102", "20240304 080102"]),
        ("dd/MMM/yyyy", ["04/Mar/2024"], ["4/Mar/2024", "04/Mar/24"]),
        ("HH'h'mm'm' ''''", ["08h01m ''"], ["08h01m '"]),
    ],
)
def test_spark_patterns_take_the_widths_they_show(pattern, good, bad):
    guard = _python(pattern_guard(pattern))
    assert all(guard.match(t) for t in good) and not any(guard.match(t) for t in bad)


def _python(guard):
    """A guard for Python's engine, which spells code points and the end of a text its own way."""
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), guard).replace("\\z", "\\Z"))
