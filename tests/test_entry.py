"""The driver contract in __spark_entry__.py."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    df = entry.entry(spark)
    assert df.columns == ["step_index", "name", "event_count", "percentage"]
    rows = df.collect()
    assert len(rows) == 3


def test_every_query_of_the_reference_operators_has_an_oracle():
    from logweave.plans.oracle import ORACLES
    from logweave.plans.workloads import QUERIES

    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(qs)


def test_reports_are_json(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    import json

    from logweave.plans import workloads as W
    from logweave.plans.report import count_report

    doc = json.loads(W._event_funnel(spark, SF, W.MAIN_FUNNEL).report().first()[0])
    assert set(doc) == {"funnel_name", "total_events_analyzed", "funnel_completed", "steps", "drop_offs"}
    assert [s["name"] for s in doc["steps"]] == ["s1_view", "s2_click", "s3_purchase"]
    assert set(doc["drop_offs"][0]) == {"from", "to", "events_lost", "drop_off_rate"}
    doc = json.loads(count_report(W.event_entries(spark, SF), W.EVENT_PATTERNS).first()[0])
    assert [p["pattern"] for p in doc["pattern_counts"]] == ["view", "click", "purchase", "sign", "error|fail"]


def test_empty_reports_have_empty_lists(entries_df):
    import json

    from logweave.operators.funnel import analyze_funnel
    from logweave.plans.report import count_report
    from logweave.specs import FunnelSpec

    none = entries_df([("x", None)]).filter("false")
    assert json.loads(count_report(none, ["a"]).first()[0]) == {"total_events_analyzed": 0, "pattern_counts": []}
    doc = json.loads(analyze_funnel(none, FunnelSpec.of("f", "a", "b"), order_by=["seq"]).report().first()[0])
    assert doc == {"funnel_name": "f", "total_events_analyzed": 0, "funnel_completed": False, "steps": [], "drop_offs": []}
