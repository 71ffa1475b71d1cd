"""End to end on small invented logs shaped like the original tool's samples:
text file -> read_log_lines -> parse_entries -> counts / funnel.  Expected values
are derived by hand from the walk rules (each is commented)."""

import pytest

from logweave.operators.count import count_patterns
from logweave.operators.funnel import analyze_funnel
from logweave.operators.parse import parse_entries, parse_stats
from logweave.sources.text import LINE_ORDER, SPLIT_CHUNK, read_log_lines
from logweave.specs import FunnelSpec, ParserSpec, Step, go_layout

WHOLE_LINE = """09:00:01 alice login
09:00:05 alice action open
09:00:09 bob login
09:00:12 alice logout
09:00:15 bob error timeout

09:00:20 bob action save
09:00:21 carol action open
09:00:30 bob logout
"""

STRUCTURED = """<10:00:00> INFO | user_1 view_product product_7
<10:00:02> INFO | user_1 add_cart product_7
<10:00:03> DEBUG | cache warm
<10:00:05> INFO | user_2 view_product product_9
<10:00:07> INFO | user_1 purchase product_7
<10:00:09> INFO | user_2 add_cart product_9
<10:00:11> WARN | user_2 payment retry
<10:00:12> INFO | user_3 view_product product_2
<10:00:15> INFO | user_2 logout
not a structured line
"""
STRUCTURED_SPEC = ParserSpec(timestamp_format=go_layout("15:04:05"),
                             log_line_regex=r"^<(\S+)> ([A-Z]+) \| (.*)$")

MIXED = """03/04 08:00:00.100 [100:101] I ActivityManager - Start proc com.shop
03/04 08:00:01.200 [100:102] D metrics - {"event": "page_view", "page": "home", "user": "a1"}
03/04 08:00:01.900 [100:102] D metrics - {"event": "page_view", "page": "item", "user": "a1"}
03/04 08:00:02.500 [100:102] D metrics - {"event": "add_to_cart", "item": "i9", "user": "a1"}
03/04 08:00:03.000 [100:103] W System - low memory
03/04 08:00:04.250 [100:102] D metrics - {"event": "purchase", "total": 19.5, "user": "a1"}
03/04 08:00:05.000 [100:102] D metrics - {"event": "page_view", "page": "home", "user": "b2"}
03/04 08:00:06.000 [100:102] D metrics - page_view fallback text
03/04 08:00:07.000 [100:102] D metrics - {"event": "add_to_cart", "item": "i3", "user": "b2"}
03/04 08:00:08.000 [100:102] D metrics - {"event": 7}
garbage line without format
"""
MIXED_SPEC = ParserSpec(
    timestamp_format=go_layout("01/02 15:04:05.000"),
    event_regex=r"metrics - (.*)",
    json_extraction=True,
    log_line_regex=r"^(\S+ \S+) \[(\d+):(\d+)\] ([A-Z]) (\w+) - (.*)$",
)


def entries(spark, tmp_path, text, spec=ParserSpec()):
    (tmp_path / "sample.log").write_text(text)
    return parse_entries(read_log_lines(spark, str(tmp_path / "sample.log")), spec)


def counts(df):
    return {p: c for _, p, c in df.orderBy("pattern_index").collect()}


def funnel(entries_df, names, limit=0, props=None):
    props = props or {}
    spec = FunnelSpec("sample", tuple(Step(n, n, props.get(n, {})) for n in names))
    r = analyze_funnel(entries_df, spec, order_by=LINE_ORDER, chunk_by=SPLIT_CHUNK, limit=limit)
    steps = [(n, c, p) for _, n, c, p in r.steps().orderBy("step_index").collect()]
    drops = [tuple(d)[1:] for d in r.drop_offs().orderBy("step_index").collect()]
    return steps, drops, tuple(r.summary().first())[1:4]


def test_whole_line_sample(spark, tmp_path):
    e = entries(spark, tmp_path, WHOLE_LINE)
    assert counts(count_patterns(e, ["login", "logout", "action", "error"])) == {
        "login": 2, "logout": 2, "action": 3, "error": 1}
    # login, action, (login: waiting for logout), logout -> one round; nothing after starts with login
    steps, drops, summary = funnel(e, ["login", "action", "logout"])
    assert [c for _, c, _ in steps] == [1, 1, 1]
    assert drops == [("login", "action", 0, 0.0), ("action", "logout", 0, 0.0)]
    assert summary == (8, True, 1)
    assert [c for _, c, _ in funnel(e, ["login", "action", "logout"], limit=1)[0]] == [1, 1, 1]
    steps, drops, summary = funnel(e, ["login", "action", "logout"], limit=-1)
    assert [c for _, c, _ in steps] == [0, 0, 0] and drops == [] and summary == (8, False, 0)


def test_structured_sample(spark, tmp_path):
    e = entries(spark, tmp_path, STRUCTURED, STRUCTURED_SPEC)
    assert tuple(parse_stats(read_log_lines(spark, str(tmp_path / "sample.log")), STRUCTURED_SPEC).first()) == (10, 9, 1)
    # three groups: the level text lands in pid (not a number -> 0), message is group 3
    first = e.orderBy(*LINE_ORDER).first()
    assert (first.level, first.tag, first.pid, first.tid, first.message) == ("", "", 0, 0, "user_1 view_product product_7")
    assert counts(count_patterns(e, ["purchase", "logout", r"user_\d+", r"product_\d+"])) == {
        "purchase": 1, "logout": 1, r"user_\d+": 8, r"product_\d+": 6}
    # view, add, purchase (round 1), view (user_3) -> M = 4 -> 2, 1, 1
    steps, drops, summary = funnel(e, ["view_product", "add_cart", "purchase"])
    assert steps == [("view_product", 2, 100.0), ("add_cart", 1, 50.0), ("purchase", 1, 50.0)]
    assert drops == [("view_product", "add_cart", 1, 50.0), ("add_cart", "purchase", 0, 0.0)]
    assert summary == (9, True, 1)
    steps, _, _ = funnel(e, ["view_product", "add_cart", "purchase"], limit=1)
    assert [c for _, c, _ in steps] == [1, 1, 1]


def test_mixed_json_sample(spark, tmp_path):
    e = entries(spark, tmp_path, MIXED, MIXED_SPEC)
    assert e.count() == 10
    # tags are not messages; a numeric event never matches; the plain-text payload falls back to the message
    assert counts(count_patterns(e, ["ActivityManager", "System", "page_view", "add_to_cart", "purchase"])) == {
        "ActivityManager": 0, "System": 0, "page_view": 4, "add_to_cart": 2, "purchase": 1}
    # view, add, purchase | view, add -> M = 5 -> 2, 2, 1
    steps, drops, summary = funnel(e, ["page_view", "add_to_cart", "purchase"])
    assert steps == [("page_view", 2, 100.0), ("add_to_cart", 2, 100.0), ("purchase", 1, 50.0)]
    assert drops == [("page_view", "add_to_cart", 0, 0.0), ("add_to_cart", "purchase", 1, 50.0)]
    assert summary == (10, True, 1)
    # step 1 needs user ^a: b2's view fails, the text fallback has no payload -> only round 1
    steps, _, _ = funnel(e, ["page_view", "add_to_cart", "purchase"], props={"page_view": {"user": "^a"}})
    assert [c for _, c, _ in steps] == [1, 1, 1]


def test_timestamp_group_without_format(spark, tmp_path):
    e = entries(spark, tmp_path, "2024-03-04 08:01:02 service started\n2024-03-04 08:01:03 request ok\n",
                ParserSpec(log_line_regex=r"^(\S+ \S+) (.*)$"))
    rows = [(r.ts, r.message) for r in e.orderBy(*LINE_ORDER).collect()]
    assert rows == [(None, "service started"), (None, "request ok")]


@pytest.mark.parametrize("text", ["", "\n\n  \n"])
def test_empty_logs(spark, tmp_path, text):
    e = entries(spark, tmp_path, text)
    assert count_patterns(e, ["x"]).count() == 0
    steps, drops, summary = funnel(e, ["x", "y"])
    assert steps == [] and drops == [] and summary == (0, False, 0)
