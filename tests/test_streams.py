"""Streams end with what the batch gives."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import assembly, baseline, fingerprint
from spanloom.streaming import assembler, files

COLS = "trace_id string, span_id string, parent_id string, operation_name string, service_name string, start_time long, duration long, tags map<string,string>, arrival long"
BASE = 1_718_000_000_000_000


@pytest.fixture(scope="module")
def rocks(spark):
    k = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(k, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(k)


def _rows():
    bad = {"error": "x", "env": "prod"}
    return [(f"t{t}", f"s{s}", "" if s == 0 else "s0", f"op{s}", "svc", BASE + t * 1000 + s, 10 + s, bad if (t, s) == (1, 2) else {"scope1": "x"}, s) for t in range(5) for s in range(4)] + [("t0", "s1", "s0", "op1", "svc", BASE + 1, 999, None, 9)]


def _batch(spark, rows):
    """The same traces by the batch operators."""
    x = spark.createDataFrame(rows, COLS)
    w = Window.partitionBy("trace_id", "span_id").orderBy(F.desc("arrival"))
    x = x.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").withColumn("tags", F.coalesce("tags", F.expr(assembly.NO_TAGS)))
    fp = fingerprint.fingerprints(x).select("trace_id", "fingerprint")
    return {r.trace_id: r for r in assembly.assemble(x).join(fp, "trace_id").collect()}


def _same(got, want):
    cols = ["service_id", "env", "operation", "root_span_id", "span_count", "start_us", "end_us", "duration_us", "has_error", "fingerprint"]
    assert set(got) == set(want) and all(got[k][c] == want[k][c] for k in want for c in cols)


def _run(df, name, checkpoint, mode, until, tries=60):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).start()
    try:
        for _ in range(tries):  # timers keep the query busy, so it never has nothing left to do
            if q.exception() or df.sparkSession.table(name).count() >= until:
                break
            time.sleep(1)
        assert q.exception() is None
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_processing_time_assembly(rocks, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "traces")
    rocks.createDataFrame(_rows(), COLS).coalesce(1).write.parquet(src)
    stream = assembler.as_stored(files.new_files(rocks, src, rocks.createDataFrame([], COLS).schema))
    put, roll = files.upsert_into(out, "trace_id", "span_count"), assembler.rollups_into(str(tmp_path / "rollups"))

    def sink(batch, i):
        if batch.isEmpty():
            return
        t = assembler.assembled(batch)
        put(t, i)
        roll(t, i)

    q = assembler.completed_spans(stream, window_ms=500).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(90):
            if q.exception() or any((tmp_path / "rollups").glob("*/_SUCCESS")) and sum(r.trace_count for r in assembler.merged_rollups(rocks, str(tmp_path / "rollups")).collect()) == 5:
                break
            time.sleep(1)
        assert q.exception() is None
    finally:
        q.stop()
    got = {r.trace_id: r for r in files.latest(rocks, out, "trace_id", "span_count").collect()}
    _same(got, _batch(rocks, _rows()))
    assert got["t1"].has_error and got["t0"].span_count == 4 and got["t0"].branches[0].duration_us in (12, 13, 999)
    merged = assembler.merged_rollups(rocks, str(tmp_path / "rollups")).collect()
    assert sum(r.trace_count for r in merged) == 5 and all(r.p99 >= r.p50 > 0 and r.sample_trace_ids for r in merged)
    # what learning takes
    assert baseline.findings(files.latest(rocks, out, "trace_id", "span_count"), ["cumulative:50"]).count() == 0


def test_event_time_assembly_and_flush(rocks, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    late = [("z", "s0", "", "op", "svc", BASE + 3_600_000_000, 5, None, 1)]
    for i, rows in enumerate((_rows(), late)):
        rocks.createDataFrame(rows, COLS).coalesce(1).write.parquet(f"{src}/f{i}")
    schema = rocks.createDataFrame([], COLS).schema
    stream = assembler.as_stored(files.new_files(rocks, f"{src}/*", schema, per_trigger=1)).withColumn("ts", F.timestamp_micros("start_time")).withWatermark("ts", "1 minute")
    seen = []

    def sink(batch, i):
        seen.extend(assembler.assembled(batch).collect() if not batch.isEmpty() else [])

    q = assembler.completed_spans(stream, event_time=True).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination(180)
    _same({r.trace_id: r for r in seen}, _batch(rocks, _rows()))
    held = {r.trace_id: r for r in assembler.assembled(assembler.pending_spans(rocks, cp)).collect()}
    _same(held, _batch(rocks, late))


def test_a_bucket_of_traces_is_one_key(rocks, tmp_path):
    """Due traces leave, the others of their bucket stay open; the state has an entry a bucket and micro-batch, not one a span."""
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    at = lambda t, s, n, arrival: (t, s, "", "op", "svc", BASE + n * 1_000_000, 5, None, arrival)
    due, later = [at(f"a{i}", f"s{j}", i + j, 1) for i in range(50) for j in range(2)], [at(f"b{i}", "s0", 100 + i, 1) for i in range(50)]
    last = [at("b7", "s0", 107, 2), at("b7", "s1", 250, 2), at("c", "s0", 300, 1)]
    for i, rows in enumerate((due + later, last)):
        rocks.createDataFrame(rows, COLS).coalesce(1).write.parquet(f"{src}/f{i}")
    stream = assembler.as_stored(files.new_files(rocks, f"{src}/*", rocks.createDataFrame([], COLS).schema, per_trigger=1)).withColumn("ts", F.timestamp_micros("start_time")).withWatermark("ts", "1 minute")
    seen = []
    q = assembler.completed_spans(stream, event_time=True).writeStream.foreachBatch(lambda b, i: seen.extend(b.collect())).outputMode("append").option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert not q.exception() and sorted((r.trace_id, r.span_id) for r in seen) == sorted((r[0], r[1]) for r in due)
    held = assembler.pending_spans(rocks, cp).collect()
    assert sorted((r.trace_id, r.span_id, r.arrival) for r in held) == sorted((r[0], r[1], r[8]) for r in later + last)

    cp = str(tmp_path / "one")
    q = assembler.completed_spans(stream, event_time=True, buckets=1).writeStream.foreachBatch(lambda b, i: b.collect() and None).outputMode("append").option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert not q.exception() and assembler.pending_spans(rocks, cp).count() == len(later + last)
    assert 1 <= rocks.read.format("statestore").option("path", cp).option("stateVarName", "spans").load().count() <= 2


def test_rollup_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("s", "f", 10 * i, 1_718_000_000 + 400 * i) for i in range(12)] + [("s", "f", 1, 1_718_100_000)]
    cols = "service_id string, fingerprint string, duration_us long, at long"
    more = lambda df: df.withColumns({"span_count": F.lit(3), "has_error": F.col("duration_us") == 20})
    more(spark.createDataFrame(rows, cols)).coalesce(1).write.parquet(src)
    stream = files.new_files(spark, src, more(spark.createDataFrame([], cols)).schema).withColumn("ts", F.timestamp_seconds("at"))
    got = _run(assembler.rollup_stream(stream, "10 minutes"), "rolled", str(tmp_path / "cp"), "append", 6)
    want = {}
    for _, _, d, at in rows[:12]:
        want.setdefault(at // 900 * 900 * 1_000_000, []).append(d)
    assert {r.window_start: (r.trace_count, r.duration_sum, r.span_count) for r in got} == {k: (len(v), sum(v), 3 * len(v)) for k, v in want.items()}
    assert sum(r.error_count for r in got) == 1


def test_upserts_survive_replay(spark, tmp_path):
    path = str(tmp_path / "t")
    write = files.upsert_into(path, "k", "v")
    a, b = spark.createDataFrame([("x", 1), ("y", 5)], "k string, v int"), spark.createDataFrame([("x", 2), ("z", 0)], "k string, v int")
    write(a, 0)
    write(b, 1)
    write(b, 1)
    assert {r.k: r.v for r in files.latest(spark, path, "k", "v").collect()} == {"x": 2, "y": 5, "z": 0}


def test_upserts_compact_and_replay(spark, tmp_path):
    path = str(tmp_path / "t")
    write = files.upsert_into(path, "k", "v", compact_every=3)
    want = {}
    for i in range(8):
        rows = [(f"k{j}", (i * 7 + j * 3) % 11) for j in range(i % 4 + 1)] * 2
        df = spark.createDataFrame(rows, "k string, v int")
        write(df, i)
        write(df, i)
        for k, v in rows:
            want[k] = max(v, want.get(k, -1))
        assert {r.k: r.v for r in files.latest(spark, path, "k", "v").collect()} == want
    assert sorted(p.name for p in (tmp_path / "t").glob("batch=*")) == ["batch=5", "batch=6", "batch=7"]


def test_event_streams_land_as_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.txt").write_text(f'event: ping\ndata: {{}}\n\nevent: trace_batch\ndata: [{{"TraceID": "t{i}", "SpanID": "a"}}]\n\n')
    q = files.event_stream(spark, str(src)).writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.TraceID for r in spark.table("landed").collect()) == ["t0", "t1", "t2"]
