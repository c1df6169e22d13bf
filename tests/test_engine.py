"""Fingerprints, trees, learning, rollups, sources and streams on fixtures."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom.functions.percentile import nearest_low, weighted
from spanloom.functions.spans import format_us, join_identity, status
from spanloom.operators import assembly, baseline, config, fingerprint, rollup, tree
from spanloom.sources import events

SIG = lambda svc, op, ident="", scope="", env="": "|".join([ident or svc, scope, "", "", env, "", "", "", op])


def _tree(spans):
    ids = [s[0] for s in spans]
    return [SIG(*s[2:]) for s in spans], fingerprint.parents_of(ids, [s[1] for s in spans])


def test_golden_hashes():
    # These hashes and the spans that give them are those of the rules.
    assert fingerprint.wl_hash([], []) == "empty"
    two = [("s1", "", "api", "GET /users"), ("s2", "s1", "db", "query")]
    assert fingerprint.wl_hash(*_tree(two)) == "fee1c9f424665252"
    tag = lambda i: (i, "tenant-a", "prod")
    three = [("s1", "", "api", "POST /pay", *tag("payments-api")), ("s2", "s1", "ledger", "write", *tag("ledger-svc")), ("s3", "s1", "notify", "send", *tag("notify-svc"))]
    assert fingerprint.wl_hash(*_tree(three)) == "e7c4ed7d9cd96bda"
    five = [("r", "", "gateway", "GET /orders"), ("a", "r", "orders", "list"), ("b", "r", "auth", "verify"), ("c", "a", "db", "select"), ("d", "a", "cache", "get")]
    for seed in range(5):
        random.Random(seed).shuffle(five)
        assert fingerprint.wl_hash(*_tree(five)) == "8ab7e704922fcfdd"
    fan = [("root", "", "fanout", "scatter")] + [(f"c{i:02d}", "root", f"worker-{i % 7}", f"shard-{i % 5}") for i in range(1, 40)]
    assert fingerprint.wl_hash(*_tree(fan)) == "d80cab49a42f6284"


def test_shape_and_hash_agree():
    rng = random.Random(1)
    by_wl, by_shape = {}, {}
    for _ in range(400):
        n = rng.randint(1, 6)
        parents = [-1] + [rng.randint(0, i - 1) for i in range(1, n)]
        names = [rng.choice("ab") for _ in range(n)]
        w, s = fingerprint.wl_hash(names, parents), fingerprint.shape_text(names, parents)
        assert by_wl.setdefault(w, s) == s and by_shape.setdefault(s, w) == w


def test_walk():
    # a 100 -> b 50, c 80; d is an orphan's tree; e <-> f with g below
    w = tree.walk([-1, 0, 0, -1, 5, 4, 5], [100, 50, 80, 10, 1, 1, 1], list("aabdefg"), [True] + 6 * [False])
    assert w["depth"] == [0, 1, 1, 0, 2, 2, 3] and w["circular"] == [False] * 4 + [True] * 3
    assert w["critical"] == [True, False, True, False, False, False, False] and w["recursive"][:4] == [False, True, False, False]
    deep = tree.walk([i - 1 for i in range(150)], [1] * 150, [str(i) for i in range(150)], [True] + 149 * [False])
    assert max(deep["depth"]) == 100 and sum(deep["critical"]) == 101


def test_status_order_and_identity(spark):
    tags = [{"http.status_code": "99"}, {"http.status_code": "1000"}, {"http.status_code": "200", "error": "true"}, {"http.status_code": "404"}, {"error": ""}, {}, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t map<string,string>")
    assert [r.s for r in df.orderBy("i").select(status(F.col("t")).alias("s")).collect()] == ["ERROR", "OK", "OK", "ERROR", "ERROR", "OK", "OK"]
    one = spark.createDataFrame([("a", "", "x", ""), ("", "", "", "")], "a string, b string, c string, d string")
    assert [r.j for r in one.select(join_identity([F.col(c) for c in "abcd"], F.lit("svc:op")).alias("j")).collect()] == ["a::x", "svc:op"]
    d = spark.createDataFrame([(0,), (-1,), (None,), (1230,), (2_500_000,), (90_000_000,)], "u long").select(format_us(F.col("u")).alias("f"))
    assert [r.f for r in d.collect()] == ["0.00ms", "0.00ms", "0.00ms", "1.23ms", "2.50s", "1.50m"]


def test_percentile_rules(spark):
    x = list(range(10))
    df = spark.createDataFrame([(x, [Row(x=1, w=1.0), Row(x=2, w=10.0), Row(x=3, w=1.0)]), ([], [])], "a array<int>, p array<struct<x:bigint,w:double>>")
    r = df.select(nearest_low(F.col("a"), 0.75).alias("q"), nearest_low(F.col("a"), 2).alias("top"), weighted(F.col("p"), 0.5).alias("w")).collect()
    assert (r[0].q, r[0].top, r[0].w) == (6, 9, 2) and (r[1].q, r[1].w) == (0, 0)
    rng = random.Random(1)
    for _ in range(200):
        s = sorted(rng.randint(0, 99) for _ in range(rng.randint(1, 30)))
        p = rng.choice([-0.5, 0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1, 1.5])
        assert baseline.percentile(s, p) == s[int((len(s) - 1) * min(1, max(0, p)))]
    pairs = [(1_000_000 + i % 50, 50.0) for i in range(200)] + [(100_000 + i, 1.0) for i in range(200)]
    assert baseline.weighted_percentile(pairs, 0.05) >= 1_000_000 and baseline.weighted_percentile(pairs, 0.01) < 200_000


def test_ring_closed_form():
    for limit in (5, 100):
        ring, seen = baseline.Ring(limit), []
        for i in range(1, 4 * limit):
            x = (i * 7919) % 1000
            seen.append(x)
            ring.put(x, i)
            n = len(seen)
            want = seen if n <= limit else seen[:1] + seen[-(limit - 1) :] if n < 2 * limit else seen[-limit:]
            assert ring.ordered == sorted(ring.slots) == sorted(want)


def _feed(service, items):
    return [f for i, (fp, start, x) in enumerate(items) for f in service.feed(f"t{i}", fp, start, x, (), False)]


M = config.MINUTE_US
BASE = 1_717_408_800_000_000  # Monday 10:00 UTC


def test_new_path_once_and_cold_start():
    s = baseline.Service(["cumulative:50"], config.Config())
    items = [("A", BASE + i * M, 100) for i in range(60)] + [("B", BASE + (60 + i) * M, 100) for i in range(40)]
    found = _feed(s, items)
    assert [f[2] for f in found] == ["new_path"]
    assert [f[2] for f in s.feed("c1", "C", BASE + 100 * M, 100, (), False)] == ["new_path"] and not s.feed("c2", "C", BASE + 101 * M, 100, (), False)
    cold = baseline.Service(["cumulative:50"], config.Config())
    assert not _feed(cold, [(f"p{i}", BASE + i * M, 100) for i in range(50)])


def test_anomaly_score_and_variants():
    s = baseline.Service(config.combinations(), config.Config())
    found = _feed(s, [("A", BASE + i * M, 100 + i % 10) for i in range(120)])
    assert not found
    got = {f[0]: f for f in s.feed("slow", "A", BASE + 120 * M, 1000, (), False) if f[1] == "anomaly"}
    assert {"cumulative:50", "cumulative:100", "ewma:50", "exponential_decay:50"} <= set(got) and not any(k.startswith("sliding") for k in got)
    assert abs(got["cumulative:50"][3] - 0.6745 * (1000 - 107) / ((107 - 102) / 1.35)) < 1e-9
    kinds = {v.kind: v for v in s.variants}
    assert kinds["cumulative"].paths["A"].n == 121 and kinds["sliding_window"].counts["A"] == 242
    assert baseline.z_score(5, 5, 5, 1, 9) == 0 and baseline.z_score(9, 5, 5, 1, 9) == 2 and baseline.z_score(1, 5, 5, 1, 9) == -2 and baseline.z_score(9, 5, 5, 3, 3) == 0


def test_frequency_drop_and_spike():
    s = baseline.Service(["cumulative:50"], config.Config(rare_threshold=0.5))
    t, items = BASE, []
    for i in range(200):  # two paths alternate, then one all but vanishes
        items.append(("A" if i % 2 else "B", t := t + 1_000_000, 100))
    for i in range(400):
        items.append(("A" if i % 40 else "B", t := t + 4_000_000, 100))
    kinds = {f[2] for f in _feed(s, items)}
    assert "frequency_drop" in kinds
    v = baseline.Variant("cumulative", {"cumulative": [50]})
    v.n, v.counts, v.first = 30_000, {"R": 60, "A": 29_940}, {"R": 0, "A": 0}
    v.recent, v.recent_n, v.previous = {"R": 10, "A": 30}, 40, {"R": 0.001, "A": 0.999}
    assert v.deviation("R", BASE, 50, None, 0.3, (), False)[0] == "frequency_spike"
    v.recent, v.recent_n, v.n, v.previous = {"R": 1, "A": 3}, 4, 90_000, {}
    kind, score, text = v.deviation("R", BASE, 50, None, 0.3, (("x->y", 1),), True)
    assert kind == "rare_path" and abs(score - (1 - 60 / 90_000 * 100)) < 1e-12 and text == "Added: [x->y]. [Contains recursive calls]"


def test_exponential_decay_count_cycles():
    p = baseline.Stats(1000)
    seen = []
    for i in range(2000):
        p.learn(10, i, "exponential_decay")
        seen.append(p.n)
    assert max(seen[500:]) == 199 and min(seen[500:]) == 190


def test_hours_and_weekends():
    day = 24 * 60 * M
    monday = BASE
    key = lambda us: [baseline.hour_key(h * config.HOUR_US) for h in baseline._comparison(us // config.HOUR_US)]
    assert key(monday)[2] == "2024-05-31-10" and key(monday - day)[2] == "2024-05-31-10" and key(monday + day)[2] == "2024-06-03-10" and key(monday - 2 * day)[2] == "2024-05-31-10"
    h = baseline.Hours()
    for off, n in zip(range(-2, 3), (108, 109, 110, 111, 112)):
        for i in range(n):
            h.learn("A" if i < 50 else "B", 100, monday + off * config.HOUR_US, f"{off}-{i}")
    assert h.share("A", monday + day) == 50 / 112 and h.share("Z", monday + day) == 0.0 and h.share("A", monday + 3 * day) is None
    n, low, high, pairs = h.path("A", monday + day)
    assert (n, low, high, len(pairs)) == (250, 100, 100, 250)


def test_slow_branches_and_diff():
    known = {k: baseline.Stats(100) for k in "ab"}
    for i in range(20):
        known["a"].learn(100 + i % 5, i)
        known["b"].learn(100, i)
    assert baseline.slow_branches((("a", 900), ("b", 101), ("c", 5000), ("a", 102)), known, 0.75) == ["a", "b"]
    assert baseline.diff_summary((("x", 1),), (("y", 1),), False) == "Added: [x]. Missing: [y]."


def test_combinations():
    assert len(config.combinations()) == 20 and config.select_combinations("active", "ewma:50") == ["ewma:50"]
    assert config.select_combinations("cumulative:100, cumulative:100", "ewma:50") == ["cumulative:100", "ewma:50"]
    for bad in ("x:50", "ewma", "ewma:51", "ewma:-1"):
        with pytest.raises(ValueError):
            config.parse_combination(bad)


def test_rollup_merge(spark):
    cols = "window_start long, service_id string, fingerprint string, at int, trace_count long, span_count long, error_count long, duration_sum long, duration_min long, duration_max long, p50 long, p99 long, sample_trace_ids array<string>"
    parts = [
        (900, "kiosk", "fp", 3, 4, 9, 0, 77, 3, 41, 17, 40, ["m", "k", "n"]),
        (900, "kiosk", "fp", 1, 5, 12, 2, 61, 2, 30, 11, 29, [f"a{i}" for i in range(9)]),
        (900, "kiosk", "fp", 2, 2, 2, 1, 10, 4, 6, 4, 6, ["k", "a0"]),
        (1800, "kiosk", "fp", 1, 1, 1, 0, 8, 8, 8, 8, 8, []),
    ]
    got = {r.window_start: r for r in rollup.merge(spark.createDataFrame(parts, cols), "at").collect()}
    # by hand, in the order of arrival: p50 (11 * 5 + 4 * 2) // 7 = 9, then (9 * 7 + 17 * 4) // 11 = 11; p99 (145 + 12) // 7 = 22, then (154 + 160) // 11 = 28
    r = got[900]
    assert (r.trace_count, r.span_count, r.error_count, r.duration_sum, r.duration_min, r.duration_max, r.p50, r.p99) == (11, 23, 3, 148, 2, 41, 11, 28)
    assert r.sample_trace_ids == [*[f"a{i}" for i in range(9)], "k"] and (got[1800].p50, got[1800].sample_trace_ids) == (8, [])


def test_event_stream_and_batches(spark):
    a = {"TraceID": "t", "SpanID": "a", "ParentID": "", "OperationName": "lend book", "StartTime": 1, "Duration": 731, "Tags": {"shelf": "7"}, "ServiceName": "library"}
    b = a | {"SpanID": "b", "ParentID": "a", "Duration": 12}
    text = f"event: ping\ndata: {{}}\n\nevent: trace_batch\ndata: {json.dumps([a, b])}\n\ndata: {json.dumps(a)}\n\ndata: nonsense\n\nevent: end\ndata: x\n\nevent: trace_batch\n\n"
    spans = events.span_batches(events.sse_events(spark.createDataFrame([(text, 4)], "value string, file int"), "value", "file"), "file")
    rows = spans.collect()
    assert sorted((r.SpanID or "-", r.bad) for r in rows) == [("-", True), ("a", False), ("a", False), ("b", False)] and {r.file for r in rows} == {4}
    assert {r.Tags["shelf"] for r in rows if not r.bad} == {"7"}


def test_requests_and_their_limits(spark):
    one = {"TraceID": "t", "SpanID": "s"}
    bodies = [json.dumps(one), json.dumps([one, {"TraceID": "", "SpanID": "x"}, one]), "[]", "no json", json.dumps([one] * 1001), json.dumps([one] * 1000), None, '{"TraceID": "' + "x" * (1 << 20) + '"}']
    spans, report = events.ingest(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"), "i", "body")
    got = {r.i: (r.accepted, r.rejected, r.error) for r in report.collect()}
    assert got[0] == (1, 0, None) and got[1] == (2, 1, None) and got[2] == (0, 0, None) and got[5] == (1000, 0, None)
    assert got[3][2] == got[6][2] == "invalid body" and got[4][:2] == (0, 0) and "1000" in got[4][2] and "too large" in got[7][2]
    assert spans.count() == 1003


def test_numbered_across_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.randint(-50, 50), i) for i in range(500)]
    got = rollup.numbered(spark.createDataFrame(rows, "k string, at long, i long"), ["k"], ["at", "i"], "at", 7).collect()
    for k in {r[0] for r in rows}:
        want = sorted((at, i) for q, at, i in rows if q == k)
        assert sorted((r.seq, r.at, r.i) for r in got if r.k == k) == [(n + 1, *x) for n, x in enumerate(want)] and {r.n_all for r in got if r.k == k} == {len(want)}


def test_path_of_a_trace_without_a_root():
    # 0 -> 1 -> 2 -> 0, with 3 -> 4 below 1
    w = tree.walk([2, 0, 1, 1, 3], [5, 1, 9, 4, 7], list("abcde"), [False] * 5)
    # from 2: 9 + 5 + 1 + (4 + 7)
    assert w["critical"] == [True] * 5 and not any(w["recursive"])
    w = tree.walk([1, 0], [3, 3], ["x", "x"], [False, False])
    assert w["critical"] == [True, True] and w["circular"] == [True, True]
    ring = [(i - 1) % 130 for i in range(130)]
    assert sum(tree.walk(ring, [1] * 130, ["x"] * 130, [False] * 130)["critical"]) == 101


def test_recursion_below_the_last_root_only():
    # first root repeats a name, the last one does not
    w = tree.walk([-1, 0, -1, 2], [1] * 4, ["a", "a", "b", "c"], [True, False, True, False])
    assert not any(w["recursive"])
    w = tree.walk([-1, 0, -1, 2], [1] * 4, ["a", "b", "c", "c"], [True, False, True, False])
    assert w["recursive"] == [False, False, False, True]


def test_states_are_saved_and_taken_up_again():
    rng = random.Random(9)
    items, t = [], BASE
    for i in range(3000):
        t += rng.choice([0, 1, 2, 40]) * 1_000_000 if i % 900 else 30 * 3600 * 1_000_000
        branches = tuple((f"b{k}", rng.randint(1, 900)) for k in range(rng.randint(0, 3)))
        items.append((f"{i:06d}", f"p{min(int(rng.expovariate(0.4)), 20)}", t, rng.randint(90, 110) if rng.random() < 0.95 else 900, branches, False))
    whole = baseline.Service(config.combinations(), config.Config())
    want = [whole.feed(*x) for x in items]
    for cut in (1, 1234, 2999):
        one = baseline.Service(config.combinations(), config.Config())
        got = [one.feed(*x) for x in items[:cut]]
        two = baseline.Service(config.combinations(), config.Config())
        two.load(one.dump())
        assert got + [two.feed(*x) for x in items[cut:]] == want
    assert sum(map(len, want)) > 100


def test_export_rows(spark):
    cols = "trace_id string, span_id string, parent_id string, name string, timestamp_micros string, duration_micros string, http_method string, env string, attributes map<string,string>"
    ok = ("t", "s", None, None, "5", "0", "GET", "", {"http.method": "PUT", "k": None, "z": "1"})
    bad = [("", "s", "", "n", "5", "1", None, None, None), ("t", None, "", "n", "5", "1", None, None, None), ("t", "s", "", "n", "0", "1", None, None, None), ("t", "s", "", "n", "5", "-1", None, None, None), ("t", "s", "", "n", "x", "1", None, None, None)]
    r = events.from_export(spark.createDataFrame([ok, *bad], cols)).collect()
    assert len(r) == 1 and r[0].tags == {"http.method": "PUT", "z": "1"} and (r[0].parent_id, r[0].operation_name, r[0].duration, r[0].service_name) == ("", "", 0, "")


def test_otlp(spark):
    doc = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "1718117510418448999", "endTimeUnixNano": "1718117510418450999", "status": {"code": "2"}, "attributes": []}] * 2}]}]}
    doc["resourceSpans"][0]["scopeSpans"][0]["spans"].insert(0, doc["resourceSpans"][0]["scopeSpans"][0]["spans"][0] | {"name": "earlier", "status": {}})
    r = events.from_otlp(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()
    assert r[0].operation_name == "n"
    assert len(r) == 1 and (r[0].service_name, r[0].start_time, r[0].duration, r[0].tags, r[0].parent_id) == ("api", 1718117510418448, 2, {"error": "true"}, "")


def _spans(spark, rows):
    cols = "trace_id string, span_id string, parent_id string, operation_name string, start_time long, duration long, tags map<string,string>, service_name string, arrival long"
    return spark.createDataFrame(rows, cols)


def test_assembly_edge_cases(spark):
    df = _spans(spark, [
        ("t", "b", "", "op", 20, 5, {"env": "prod"}, "svc", 1), ("t", "a", "", "first", 10, 5, {"scope1": "x", "error": ""}, "api", 1),
        ("u", "c", "gone", "", 30, 5, {"operation": "tagged"}, "only", 1), ("v", "d", "", "", 5, 0, {}, "", 1),
    ])
    got = {r.trace_id: r for r in assembly.assemble(df).collect()}
    assert got["t"].root_span_id == "a" and got["t"].service_id == "api:x:::prod::::first" and got["t"].has_error and got["t"].duration_us == 15
    assert got["u"].root_span_id == "c" and got["u"].service_id == "only::::::::tagged" and got["v"].service_id == ":"
    short = assembly.assemble(df, config.Config(identity_fields=("service_name", "color")))
    assert {r.trace_id: r.service_id for r in short.collect()}["t"] == "api"
    assert assembly.assemble(df.limit(0)).count() == 0 and fingerprint.fingerprints(df.limit(0)).count() == 0


def test_traces_ahead_of_the_wall_clock():
    s = baseline.Service(["cumulative:50"], config.Config(wall_us=BASE))
    s.feed("a", "A", BASE, 1, (), False)
    s.feed("b", "B", BASE + 10 * M, 1, (), False)
    assert s.clock == BASE and s.variants[0].first["B"] == BASE and len(s.hours.buckets) == 1
    s.feed("c", "C", BASE + 5 * M, 1, (), False)
    assert s.clock == BASE + 5 * M
