"""The read interface over the smallest data folder."""

import json
from pathlib import Path

import pytest

from spanloom.plans.api import Engine

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no data")


def test_reads(spark):
    e = Engine(spark, FOLDER)
    top = e.recent_traces(3).collect()
    assert len(top) == 3 and top[0].start_us >= top[1].start_us >= top[2].start_us
    t = top[0]
    assert all(r.fingerprint == t.fingerprint for r in e.traces_by_fingerprint(t.fingerprint, 5).collect())
    assert e.service(t.service_id).count() == 1 and e.topologies(t.service_id).count() >= 1
    assert all(r.trace_id == t.trace_id for r in e.trace(t.trace_id).collect())
    base, branches = e.baselines(t.service_id)
    assert base.count() == 1 and set(branches.columns) >= {"branch_key", "p50"}
    assert e.anomalies(limit=7).count() <= 7 and all(r.score >= 3.5 for r in e.anomalies().collect())
    assert e.deviations(min_score=0.9, variant="cumulative:500").filter("score < 0.9").count() == 0
    s = e.stats().collect()
    assert len(s) == 1 and s[0].traces > 0 and s[0].topologies > 0
    assert e.services(search="no such service").count() == 0 and e.services(env="prod", only_errors=True).filter("error_rate = 0").count() == 0
    values = [r.value for r in e.facets("scope1").collect()]
    assert values == sorted(values) and e.interesting(limit=4).count() == 4


def test_choices(spark):
    e = Engine(spark, FOLDER)
    assert e.set_active("ewma:100") == e.active == "ewma:100" and len(e.combinations()) == 20
    for bad in (lambda: e.set_active("ewma:7"), lambda: e.facets("color"), lambda: e.services(color="x")):
        with pytest.raises(ValueError):
            bad()


def test_point_reads_prune(spark):
    e = Engine(spark, FOLDER)
    t = e.recent_traces(1).collect()[0].trace_id
    df = e.trace(t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(trace_id," in plan
    assert e.trace("no id").count() == 0 and e.topology_example("none", "none").count() == 0
    with pytest.raises(LookupError):
        e.service("none")


def test_ingest_then_read(spark):
    e = Engine(spark, FOLDER)
    t = "ab" * 16
    span = {"TraceID": t, "SpanID": "00000000000000a1", "ParentID": "", "OperationName": "op", "StartTime": 1_718_000_000_000_000, "Duration": 5, "Tags": {}, "ServiceName": "new"}
    got = e.ingest([json.dumps([span, span | {"SpanID": ""}]), "{"], 1_718_000_000_000_009).collect()
    assert [(r.accepted, r.rejected, r.error) for r in got] == [(1, 1, None), (0, 0, "invalid body")]
    assert [(r.service_name, r.duration_us) for r in e.trace(t).collect()] == [("new", 5)]
    e.ingest([json.dumps(span | {"Duration": 7})], 1_718_000_000_000_010)
    assert [r.duration_us for r in e.trace(t).collect()] == [7] and e.health() == {"status": "ok"}


def test_settings_are_kept(spark, tmp_path):
    kept = str(tmp_path / "settings")
    Engine(spark, FOLDER, settings=kept).set_active("sliding_window:500")
    assert Engine(spark, FOLDER, settings=kept).active == "sliding_window:500"
    e = Engine(spark, FOLDER)
    assert e.variant("cumulative:500").count() <= 1
    with pytest.raises(ValueError):
        e.variant("cumulative:7")
