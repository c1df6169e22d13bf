"""Log sketches and top lists against brute force."""

import math
import random

import numpy as np

from spanloom.llm import logsketch, topn
from spanloom.workdir import new_path


def test_percentiles_within_bound(spark):
    rng = random.Random(2)
    values = {"a": [rng.randint(1, 10**7) for _ in range(3000)], "b": [rng.gauss(0, 1e4) for _ in range(2000)], "c": [0.0] * 5 + [-3.0], None: [7.5], "inf": [math.inf, -math.inf, 1.0]}
    rows = [(k, float(v), rng.randint(0, 4)) for k, vs in values.items() for v in vs] + [("a", None, 0), ("a", math.nan, 1), ("z", None, 0)]
    df = spark.createDataFrame(rows, "k string, v double, day int")
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    whole = logsketch.percentiles(logsketch.sketch(df, ["k"], "v"), ["k"], qs).collect()
    days = [logsketch.sketch(df.filter(f"day = {d}"), ["k"], "v") for d in range(5)]
    parts = logsketch.percentiles(logsketch.combine(days, ["k"]), ["k"], qs).collect()
    key = lambda r: (str(r.k), r.q)
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, parts), key=str)
    assert {r.k for r in whole} == set(values) and len(whole) == len(qs) * len(values)
    for r in sorted(whole, key=key):
        exact = sorted(values[r.k])[math.floor(r.q * (len(values[r.k]) - 1))]
        assert r.n == len(values[r.k])
        assert r.estimate == exact or abs(r.estimate - exact) <= logsketch.ALPHA * abs(exact) * (1 + 1e-9), (r, exact)
    assert logsketch.sketch(df.limit(0), ["k"], "v").count() == 0


def test_checked_gives_exact_values(spark):
    rng = random.Random(6)
    values = {"a": [rng.randint(-50, 10**6) for _ in range(2000)], None: [3, 3, 4], "same": [7] * 900}
    df = spark.createDataFrame([(k, v, "x") for k, vs in values.items() for v in vs] + [("none", None, "x")], "k string, v long, code string").drop("code")
    got = logsketch.checked(df, ["k"], "v", [0.0, 0.5, 0.99]).collect()
    assert len(got) == 9 and all(r.within for r in got)
    for r in got:
        assert r.exact == sorted(values[r.k])[math.floor(r.q * (len(values[r.k]) - 1))]


def test_names_that_share_no_hash(spark, tmp_path):
    from spanloom.llm import queries

    rows = [("a" * 32, "1", None, 1704067200, 5, "svc", 2), ("A" * 32, "01", None, 1704067200, 9, None, 3), ("b" * 32, "1", None, None, None, "svc", 1), ("", "1", None, 1, 1, "no", 1)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, start_time long, duration long, service_name string, arrival long")
    got = sorted(map(tuple, queries._named_durations(df).collect()), key=str)
    assert got == [("svc", None, 1), (None, 9, 3)] or got == [(None, 9, 3), ("svc", None, 1)]


def test_layers_never_share_a_row_group(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    g = ["big"] * 500 + [f"s{i % 200}" for i in range(800)]
    t = pa.table({"g": g, "id": pa.array(np.arange(1300)), "score": pa.array(rng.random(1300))})
    file = topn._write_file(t, f"file://{tmp_path}")
    out, groups, read = topn.read_file(file, 5)
    assert groups == 1 + int(topn.layers(np.array([499]))[0]) and read == 1
    want = {i for k in set(g) for i in sorted((j for j in range(1300) if g[j] == k), key=lambda j: -t["score"][j].as_py())[:5]}
    assert set(out.column(1).to_pylist()) == want


def test_top_n_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 50)}", i, float(rng.randint(0, 300))) for i in range(30_000)]
    rows += rows[:500] + [("g1", None, 5.0), (None, 99999, 5.0), ("g1", 99998, None), ("g1", 99997, math.nan), ("g1", 99996, math.inf), ("lone", 99995, -0.0)]
    df = spark.createDataFrame(rows, "g string, id long, score double").withColumnRenamed("g", "g").selectExpr("*", "'x' as rank")
    files = topn.clustered(df, new_path(spark, "t"), 4)
    best: dict = {}
    for g, i, s in set(r for r in rows if None not in r and math.isfinite(r[2])):
        best.setdefault(g, []).append((-s, i))
    for n in (1, 5, 40):
        want = {(g, i, k + 1) for g, x in best.items() for k, (_, i) in enumerate(sorted(x)[:n])}
        assert {(r.g, r.id, r["rank"]) for r in topn.top_n(files, n).collect()} == want
    read = topn.skipping(files, 5).collect()
    assert sum(r.n_read for r in read) <= sum(r.n_row_groups for r in read)
    assert topn.top_of_each(df.limit(0), 3).count() == 0


def test_skipping_saves_reading(tmp_path):
    import pyarrow as pa

    topn_rows = 40 * topn.ROWS_PER_ROW_GROUP
    rng = np.random.default_rng(0)
    t = pa.table({"g": pa.array(["big"] * topn_rows + ["small"]), "id": pa.array(np.arange(topn_rows + 1)), "score": pa.array(np.r_[rng.random(topn_rows), 2.0])})
    out, groups, read = topn.read_file(topn._write_file(t, f"file://{tmp_path}"), 5)
    assert groups >= 40 and read == 1 and out.num_rows == 6
