"""Queries give all rows and columns, also those that their SQL cannot express."""

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def q(spark):
    found = entry.queries()
    return lambda name: found[name](spark, SMALL)


def test_all_durations_and_merged_columns(q):
    shown = q("ref_w8_format")
    assert shown.count() == q("ref_w3_timing").count()
    assert {"p50", "p99", "sample_trace_ids"} <= set(q("ref_a9_rollup_merge").columns) and q("ref_a9_rollup_merge").filter("p50 > 0 and size(sample_trace_ids) > 0").count() > 0
    assert "samples" in q("ref_a14_hourly").columns


def test_spans_in_circles_and_too_deep(spark, monkeypatch):
    from spanloom.plans import engine_queries as e

    rows = [("deep", f"{i:04d}", f"{i - 1:04d}" if i else "") for i in range(103)] + [("loop", "a", "b"), ("loop", "b", "a"), ("loop", "c", "b"), ("one", "x", "gone")]
    df = spark.createDataFrame([(t, s, p, i, 1, "svc", f"op{i}") for i, (t, s, p) in enumerate(rows)], "trace_id string, span_id string, parent_id string, start_time long, duration long, service_name string, operation_name string")
    monkeypatch.setattr(e, "spans", lambda s, d: df)
    depth = {(r.trace_id, r.span_id): r.depth for r in e.w1(spark, "").collect()}
    assert len(depth) == len(rows) and depth["deep", "0102"] == 100 and depth["loop", "c"] > 0
    assert {r.trace_id: r.recursive for r in e.f5(spark, "").collect()} == {"deep": False, "loop": False, "one": False}
    below = {(r.trace_id, r.span_id): r.shown_below for r in e.w6(spark, "").collect()}
    assert below["deep", "0099"] == "0098" and below["deep", "0100"] == below["deep", "0102"] == below["loop", "a"] == below["loop", "c"] == below["one", "x"] == ""
