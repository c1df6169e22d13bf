"""Orphans, hierarchies, late events, skewed keys and repeated messages against plain Python on small tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.event_time import event_us
from spanloom.functions.ids import parent_bits, span_bits, span_hex, trace_bits, trace_hex
from spanloom.operators import dedup, hierarchy, late, orphans, skew
from spanloom.sources.tables import usable_spans

SPANS = "trace_id string, span_id string, parent_id string, operation_name string, start_time long, duration long, tags map<string,string>, service_name string, arrival long, batch_id long"


def T(n):
    return f"{n:032x}"


def S(n):
    return f"{n:016x}"


def span(t, s, p="", start=1_718_000_000_000_000, arrival=1, **kw):
    r = {"trace_id": t, "span_id": s, "parent_id": p, "operation_name": "o", "start_time": start, "duration": 5, "tags": None, "service_name": "x", "arrival": arrival, "batch_id": 1} | kw
    return tuple(r.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, SPANS)


def test_id_spellings(spark):
    texts = ["00000000000000ab", "AB", " ab ", "0xAB", "0Xab", "\tab\n", "a-b", "", "  ", None, "0x", "zz", "1" + "0" * 16, "0", "0000", "ffffffffffffffff", "8000000000000000"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", span_hex(span_bits(F.col("x"))).alias("h"), span_hex(parent_bits(F.col("x"))).alias("p"))
    got = {r.i: (r.h, r.p) for r in rows.collect()}
    ab = S(0xAB)
    assert [got[i][0] for i in range(7)] == [ab] * 7 and [got[i][0] for i in range(7, 13)] == [None] * 6
    assert got[13] == got[14] == (S(0), None) and got[15][0] == "f" * 16 and got[16][0] == "8" + "0" * 15
    t = ["abcdef0123456789abcdef0123456789", "ABCDEF01-2345-6789-ABCD-EF0123456789", "1", "x" * 32, "1" * 33]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, x string")
    hi, lo = trace_bits(F.col("x"))
    h = {r.i: r.h for r in df.select("i", trace_hex(hi, lo).alias("h")).collect()}
    assert h == {0: t[0], 1: t[0], 2: T(1), 3: None, 4: None}


def test_event_time_units(spark):
    us = 1_718_117_510_418_448
    vals = [us, us // 1000, us // 1_000_000, us * 1000 + 7, 0, -5, None, 5, 10**14, 1_830_297_600_000_000]
    got = [r.e for r in spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v long").orderBy("i").select(event_us(F.col("v")).alias("e")).collect()]
    assert got == [us, us // 1000 * 1000, us // 1_000_000 * 1_000_000, us, None, None, None, None, None, None]


def _random_spans(seed, traces=30, repeats=0.3):
    rng = random.Random(seed)
    rows = []
    for t in range(traces):
        n = rng.randint(1, 25)
        for s in range(n):
            kind = rng.random()
            p = "" if kind < 0.1 else S(99) if kind < 0.2 else S(rng.randint(1, n)) if kind < 0.5 else S(rng.randint(1, max(1, s)))
            for k in range(1 + (rng.random() < repeats) * rng.randint(1, 3)):
                rows.append(span(rng.choice([T(t), T(t).upper(), "0x" + T(t)]), rng.choice([S(s + 1), f" {S(s + 1)}", f"{s + 1:x}"]), p if k == 0 else S(rng.randint(1, n)), arrival=1000 * s + k))
    rows += [span(None, S(1)), span("", S(1)), span(T(0), "  "), span(T(0), None)]
    rng.shuffle(rows)
    return rows


def _valid(rows):
    best = {}
    for r in rows:
        t, s = (x.strip().lower().removeprefix("0x").zfill(n) if x and x.strip() else None for x, n in ((r[0], 32), (r[1], 16)))
        if t and s and ((t, s) not in best or best[t, s][0] < r[8]):
            best[t, s] = (r[8], r[2])
    return {k: v[1] or None for k, v in best.items()}


def _walk(valid):
    """Root, depth, cycle and number of descendants of every span, by following parents."""
    out, below = {}, Counter()
    for t, s in valid:
        path, x = [s], s
        while (p := valid[t, x]) and (t, p) in valid and p not in path:
            path.append(p)
            x = p
        p = valid[t, x]
        if p and (t, p) in valid:
            out[t, s] = (None, None, min(path[path.index(p) :]))
        else:
            out[t, s] = (x, len(path) - 1, None)
            for a in path[1:]:
                below[t, a] += 1
    return out, below


@pytest.mark.parametrize("task_rows", [100_000, 8, 0])
def test_hierarchy_in_tasks_and_by_joins(spark, task_rows):
    rows = _random_spans(7)
    want, below = _walk(_valid(rows))
    nodes = hierarchy.hierarchy(usable_spans(frame(spark, rows)), with_path=True, task_rows=task_rows)
    h = nodes.select(trace_hex(F.col("th"), F.col("tl")).alias("t"), span_hex(F.col("s")).alias("s"), span_hex(F.col("root")).alias("root"), "depth", span_hex(F.col("cycle")).alias("cycle"), "n_below", "path").collect()
    assert {(r.t, r.s): (r.root, r.depth, r.cycle) for r in h} == want and len(h) == len(want)
    assert any(r.cycle for r in h) and any((r.depth or 0) > 3 for r in h)
    for r in h:
        if r.cycle:
            assert r.path is None and r.n_below is None
        else:
            ids = r.path.split("/")
            assert r.n_below == below[r.t, r.s] and ids[0] == r.root and ids[-1] == r.s and len(ids) == r.depth + 1
    pairs = hierarchy.descendants(nodes).collect()
    assert Counter((p.trace_id, p.ancestor_id) for p in pairs) == +below


@pytest.mark.parametrize("task_rows", [100_000, 10])
def test_long_chain_and_large_cycle(spark, task_rows):
    n = 700
    rows = [span(T(1), S(i), S(i - 1) if i > 1 else "", arrival=i) for i in range(1, n + 1)]
    rows += [span(T(2), S(i + 5), S((i + 1) % 50 + 5)) for i in range(50)] + [span(T(2), S(1000), S(40)), span(T(2), S(1001), S(1000)), span(T(3), S(7), S(7))]
    h = hierarchy.hierarchy(usable_spans(frame(spark, rows)), task_rows=task_rows)
    got = {(r.tl, r.s): (r.depth, r.cycle, r.n_below) for r in h.collect()}
    assert all(got[1, i] == (i - 1, None, n - i) for i in range(1, n + 1))
    assert all(v[1] == 5 for k, v in got.items() if k[0] == 2) and got[3, 7][1] == 7


def test_orphans(spark):
    rows = _random_spans(3)
    valid = _valid(rows)
    at = "timestamp'2024-06-10 00:20:00'"
    refs = {
        "traces": spark.sql(f"select * from values ('{T(1)}', {at}), ('{T(1)}', {at}), ('{T(500)}', {at}), ('{T(500)}', null), (null, {at}) as t(trace_id, created_at)"),
        "pending_traces": spark.sql(f"select '{T(501)}' as trace_id, cast(null as timestamp) as first_seen, 1 as src"),
        "anomalies": spark.sql(f"select '{T(2)}' as trace_id, {at} as created_at").limit(0),
        "deviations": spark.sql(f"select '{T(2)}' as trace_id, {at} as created_at"),
    }
    got = sorted(map(tuple, orphans.find_orphans(frame(spark, rows), refs).collect()))
    want = [("spans", t, s) for (t, s), p in valid.items() if p and (t, p) not in valid] + [("traces", T(500), ""), ("pending_traces", T(501), "")]
    assert got == sorted(want)
    counts = {(r.src, r.period_us): (r.n_refs, r.n_dangling) for r in orphans.orphan_counts(frame(spark, rows), refs).collect()}
    assert sum(v[1] for k, v in counts.items() if k[0] == "spans") == len(want) - 2
    period = 1_717_978_500_000_000
    assert counts["traces", period] == (3, 1) and counts["traces", None] == (1, 1) and counts["pending_traces", None] == (1, 1) and counts["deviations", period] == (1, 0)
    none = frame(spark, [])
    assert {r.src for r in orphans.find_orphans(none, refs).collect()} == {"traces", "pending_traces", "deviations"}


def test_late_triangle(spark):
    h, q = 3_600_000_000, 900_000_000
    base = 1_718_000_100_000_000 - 1_718_000_100_000_000 % h
    recs = [("a", 1, 1, 1, base, base, 10), ("a", 1, 1, 2, base + 1, base + q + h, 5), ("a", 1, 1, 3, base + 1, base + q + h + 1, 7), ("a", 1, 1, 4, base + q, base + q, 1), ("a", 1, 1, 5, None, base, 1), ("a", 1, 1, 6, base, None, 1), ("a", 1, 1, 7, base + 2, base - 1, 100), ("b", 1, 1, 1, base, base, None)]
    # delivered again: with another value in a later period, in another period of the event, after the cut-off, and twice in one arrival period
    recs += [("c", 1, 1, 1, base, base + 1, 10), ("c", 1, 1, 1, base, base + 2 * q, 4), ("c", 1, 1, 2, base, base, 1), ("c", 1, 1, 2, base + 4 * q, base + q, 2), ("c", 1, 1, 3, base, base, 50), ("c", 1, 1, 3, base, base + q + h + 5, 60)]
    recs += [("d", 1, 1, 1, base, base + 1, 10), ("d", 1, 1, 1, base, base + 2, 11), ("d", 1, 1, 1, base, base + 2, 11), ("d", 1, 1, 2, base, base + q + h, 3), ("d", 1, 1, 2, base, base + q + h + 9, 4)]
    df = spark.createDataFrame(recs, "src string, k1 long, k2 long, k3 long, event_us long, arrival_us long, value long")
    assert [r.trace_id for r in late.late_records(df.filter("src = 'a'")).collect()] == [f"{1:016x}{1:016x}"]
    rev = {(r.src, r.period - base, r.revision): (r.n_added, r.n_so_far, r.total_so_far, r.is_final) for r in late.revisions(late.triangle(late.changes(df))).collect()}
    assert rev[("a", 0, 1)] == (1, 1, 100, False) and rev[("a", 0, 2)] == (1, 2, 110, False) and rev[("a", 0, 3)] == (1, 3, 115, True)
    assert rev[("a", q, 1)] == (1, 1, 1, True) and rev[("b", 0, 1)] == (1, 1, 0, True)
    # no revision shows what came later: 61 first, then a span moves to another period, then 10 becomes 4
    assert rev[("c", 0, 1)] == (3, 3, 61, False) and rev[("c", 0, 2)] == (-1, 2, 60, False) and rev[("c", 0, 3)] == (0, 2, 54, True) and rev[("c", 4 * q, 1)] == (1, 1, 2, True)
    assert rev[("d", 0, 1)] == (1, 1, 11, False) and rev[("d", 0, 2)] == (1, 2, 14, True)
    assert late.revisions(late.triangle(late.changes(df.limit(0)))).count() == 0 and late.late_records(df.limit(0)).count() == 0


def test_ids_in_sql_as_in_columns(spark):
    from spanloom.functions.ids import SPAN_DIGITS, span_text, text_sql

    texts = [None, "", " ", "0x", "0X1f", "1F", "-1-f-", "\u00a01f", "00000000000000001f", "12345678901234567", "xyz", "0123456789abcdef", "0123456789ABCDEG", "0x0"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = df.select("x", span_text(F.col("x")).alias("a"), F.expr(text_sql("x", SPAN_DIGITS).replace("{{", "{").replace("}}", "}")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    want = {"0X1f": "1f", "1F": "1F", "-1-f-": "1f", "\u00a01f": "1f", "00000000000000001f": "1f", "0123456789abcdef": "0123456789abcdef", "0x0": "0"}
    assert {r.x: r.a for r in got if r.a is not None} == {k: v.zfill(16) for k, v in want.items()}


def test_pending_instants(spark):
    p = spark.sql(f"select * from values ('{T(1)}', timestamp'2024-06-10 00:00:00', null), ('{T(1)}', timestamp'2024-06-10 02:00:00', timestamp'2024-06-09 23:59:59'), ('{T(2)}', null, null), (null, timestamp'2024-06-10', null) as t(trace_id, first_seen, last_seen)")
    got = {r.k2: r for r in late.pending_records(p).collect()}
    assert len(got) == 2 and {r.arrival_us and r.arrival_us - r.event_us for r in got.values()} == {7_201_000_000, None}


def test_paths_of_a_deep_chain_leave_in_bounded_batches():
    n = 20_000
    s, z = np.arange(1, n + 1), np.zeros(n, np.int64)
    r = hierarchy.resolve(z, z, s, s - 1, s > 1, s, True)
    assert r["depth"].tolist() == list(range(n)) and r["n_below"].tolist() == list(range(n - 1, -1, -1))
    for i in (0, 63, 64, 65, 127, 128, 129, 4000, n - 1):
        assert hierarchy._paths(r, i, i + 1) == ["/".join(f"{x:016x}" for x in range(1, i + 2))]
    seen = 0
    for k, b in enumerate(hierarchy._to_batches(r, True)):
        seen += b.num_rows
        assert b.nbytes < 2 * hierarchy.BATCH_BYTES
        if k > 20:
            break
    assert seen > 5000


def test_quotient_table_is_exact():
    rng = np.random.default_rng(1)
    w = [rng.integers(0, 4, 20_000).astype(np.uint64) for _ in range(3)]
    back = dedup.unpermute(*dedup.permute(*w))
    assert all((a == b).all() for a, b in zip(w, back))
    state, seen = dedup._Copies(), Counter()
    for a in range(0, 20_000, 777):
        part = [x[a : a + 777] for x in w]
        m = len(part[0])
        state.add(dedup.permute(*part), np.ones(m, np.int64), np.zeros(m, np.int64), np.arange(m))
        seen.update(zip(*map(np.ndarray.tolist, part)))
    at = state.table.slots()
    ids = zip(*map(np.ndarray.tolist, dedup.unpermute(*state.table.identifiers(at, 0))))
    assert state.table.n == len(seen) == 64 and dict(zip(ids, state.copies[at].tolist())) == seen


@pytest.mark.parametrize("shard_bits", [0, 1, 5])
def test_identifiers_come_back_from_remainders(shard_bits):
    rng = np.random.default_rng(shard_bits)
    w = dedup.permute(*[rng.integers(0, 2**64, 60_000, np.uint64) for _ in range(3)])
    shard = dedup.shard_of(w[0], shard_bits)
    assert np.bincount(shard, minlength=1 << shard_bits).std() < 400
    for k in range(1 << shard_bits):
        mine = [x[shard == k] for x in w]
        table = dedup.QuotientTable(4, shard_bits)
        slots, _ = table.insert(mine, k)
        for x, y in zip(table.identifiers(slots, k), mine):
            assert (x == y).all()
        # the quotient is not stored: the first word holds the remainder and a distance
        assert (table.first[slots] & table.low == mine[0] & table.low).all() and int((table.first[slots] >> table.rest).max()) < 200
        again, moved = table.insert([x[:100] for x in mine], k)
        assert (again == (slots if moved is None else moved[slots])[:100]).all() and table.n == len(mine[0])


def test_crowded_slots_grow_the_table():
    # one home slot and a distance of at most three: the table has to grow
    w = [np.arange(40, dtype=np.uint64) << np.uint64(50), np.zeros(40, np.uint64), np.zeros(40, np.uint64)]
    table = dedup.QuotientTable(2)
    slots, _ = table.insert(w)
    assert len(set(slots.tolist())) == 40 and all((x == y).all() for x, y in zip(table.identifiers(slots, 0), w))


def test_one_copy_each(spark, monkeypatch):
    rows = _random_spans(11, repeats=0.8) + [span(T(9), S(3), arrival=10**9)] * 500 + [span(T(9), S(4), arrival=None)]
    want = {}
    for t, s in [(x[0], x[1]) for x in rows]:
        pass
    u = usable_spans(frame(spark, rows), "service_name").withColumn("copies", F.lit("clash")).withColumn("shard", F.lit(1))
    by = {(r.th, r.tl, r.s): r for r in dedup.one_copy_each(u).collect()}
    plain = {(r.th, r.tl, r.s): (r.a, r.n) for r in u.groupBy("th", "tl", "s").agg(F.max("arrival").alias("a"), F.count("*").alias("n")).collect()}
    assert {k: (r.arrival, r.copies) for k, r in by.items()} == plain and len(by) == len(plain)
    valid = _valid([r for r in rows if r[8] is not None])
    got = {(r.t, r.s): r.p for r in dedup.one_copy_each(u).select(trace_hex(F.col("th"), F.col("tl")).alias("t"), span_hex(F.col("s")).alias("s"), span_hex(F.col("p")).alias("p"), "arrival").filter("arrival is not null").collect()}
    assert got == valid
    assert dedup.one_copy_each(u.limit(0)).count() == 0


def test_tied_copies_and_small_tables():
    c = dedup._Copies()
    w = [np.array([5, 5, 5, 6], np.uint64)] * 3
    c.add(w, np.ones(4, np.int64), np.array([3, 9, 9, 1]), np.arange(4))
    c.add([x[:1] for x in w], np.ones(1, np.int64), np.array([9]), np.array([4]))
    at = c.table.slots()
    assert sorted(zip(c.copies[at].tolist(), c.arrival[at].tolist())) == [(1, 1), (4, 9)] and set(c.row[at].tolist()) <= {1, 3, 4}


def test_packing_is_balanced(spark):
    rng = random.Random(1)
    keys = ["hot"] * 4000 + ["warm"] * 1500 + [f"k{i % 700}" for i in range(5000)] + [None] * 50
    rng.shuffle(keys)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    f = skew.Fragments(df, ["k"], tasks=8)
    per = [len(x) for x in f.facts(df, "i").rdd.glom().collect()]
    assert sum(per) == len(keys) and max(per) < 1.35 * len(keys) / 8 and max(f.planned) < 1.3 * len(keys) / 8
    got = {r.k: r.n for r in skew.spread_aggregate(df, ["k"], ["i"], [F.count("*").alias("n")], [F.sum("n").alias("n")], 8).collect()}
    assert got == dict(Counter(keys))
    dims = spark.createDataFrame([("hot", 1, "a"), ("hot", 2, "b"), ("k5", 3, "c"), ("absent", 4, "d"), (None, 5, "e")], "k string, i int, name string")
    j = skew.spread_join(df, dims, ["k"], ["i"], "left", 8)
    assert set(j.columns) == {"k", "i", "dim_i", "name"}
    c = Counter((r.k, r.dim_i) for r in j.collect())
    plain = Counter((r.k, r.j) for r in df.join(dims.select("k", F.col("i").alias("j")), "k", "left").collect())
    assert c == plain
    assert skew.spread_join(df, dims, ["k"], ["i"], "inner", 8).count() == 8000 + keys.count("k5")
    # the matching side goes to as many tasks as a key has shards, no more
    m = Counter(r.k for r in f.matching(dims).collect())
    assert m["k5"] == m["absent"] == 1 and 2 <= m["hot"] // 2 <= 8
    assert skew.spread_aggregate(df.limit(0), ["k"], ["i"], [F.count("*").alias("n")], [F.sum("n").alias("n")], 4).count() == 0


def test_lpt_order():
    at = skew.pack([("a", 9), ("b", 5), ("c", 4), ("d", 1)], 2)
    assert at == [0, 1, 1, 0] or at[0] != at[1] == at[2]
