"""The read interface and the streams as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.ids import span_hex, trace_hex
from spanloom.operators.config import THRESHOLDS, VARIANTS, combinations
from spanloom.plans import engine_queries as e
from spanloom.plans.api import Engine
from spanloom.plans.engine_queries import ASM, FI, K, R, STATUS, traces
from spanloom.sources.tables import table, usable_spans
from spanloom.streaming import assembler, files
from spanloom.workdir import drop, exists, new_path, scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: The service asked for: the last one by name; the path asked for: its last one by name.
_SID = f"(WITH {R} SELECT max(service_id) FROM r)"
_FP = f"(WITH {R} SELECT max(fingerprint) FROM r WHERE service_id = (SELECT max(service_id) FROM r))"


def _chosen(s, d) -> tuple[str, str]:
    r = traces(s, d).agg(F.max(F.struct("service_id", "fingerprint")).alias("m")).collect()[0].m
    return r.service_id, r.fingerprint


@query("ref_a2_service", f"SELECT * FROM ({e.ORACLE['ref_a1_services']}) WHERE service_id = {_SID}")
def a2(s, d):
    """One service of the list."""
    return Engine(s, d).service(_chosen(s, d)[0]).select("service_id", "trace_count", "topology_count", "error_rate", "last_seen", "p50", "p75", "deviation_count", "anomaly_count")


@query("ref_x3_topologies", f"SELECT * FROM ({e.ORACLE['ref_a3_topologies']}) WHERE service_id = {_SID} ORDER BY n DESC, fingerprint")
def x3(s, d):
    """Paths of one service, the most frequent first."""
    return Engine(s, d).topologies(_chosen(s, d)[0])


@query("ref_api_topology_example", f"WITH {K}, {R} SELECT trace_id, span_id, dur AS duration_us, {STATUS} AS status FROM k WHERE trace_id = (SELECT trace_id FROM r WHERE service_id = {_SID} AND fingerprint = {_FP} ORDER BY start_us, trace_id LIMIT 1)")
def topology_example(s, d):
    """Spans of the first trace of a path."""
    return Engine(s, d).topology_example(*_chosen(s, d)).select("trace_id", "span_id", "duration_us", "status")


@query("ref_api_deviations", f"WITH {FI} SELECT id, score FROM f WHERE kind = 'deviation' AND score >= 0.5 AND NOT isnan(score) ORDER BY created_at DESC, id DESC LIMIT 100")
def api_deviations(s, d):
    return Engine(s, d).deviations(min_score=0.5).select("id", "score")


@query("ref_api_anomalies", f"WITH {FI} SELECT id, score FROM f WHERE kind = 'anomaly' AND score >= 3.5 AND NOT isnan(score) AND variant = 'cumulative:500' ORDER BY created_at DESC, id DESC LIMIT 100")
def api_anomalies(s, d):
    return Engine(s, d).anomalies(variant="cumulative:500").select("id", "score")


@query("ref_api_by_fingerprint", f"WITH {R} SELECT trace_id, service_id, start_us FROM r WHERE fingerprint = {_FP} ORDER BY start_us DESC, trace_id LIMIT 50")
def by_fingerprint(s, d):
    return Engine(s, d).traces_by_fingerprint(_chosen(s, d)[1]).select("trace_id", "service_id", "start_us")


@query("ref_api_interesting", f"WITH {FI} SELECT kind, id FROM f WHERE variant = 'cumulative:500' ORDER BY created_at DESC, kind, id DESC LIMIT 50")
def interesting(s, d):
    return Engine(s, d).interesting("cumulative:500").select("kind", "id")


@query("ref_api_interesting_trace", f"SELECT * FROM ({e.ORACLE['ref_s14_interesting_upsert']}) WHERE trace_id = (SELECT max(trace_id) FROM anomalies)")
def interesting_trace(s, d):
    return Engine(s, d).interesting_trace(table(s, d, "anomalies").agg(F.max("trace_id")).collect()[0][0])


@query("ref_api_baselines", f"SELECT service_id, n, p50, p99 FROM ({e.ORACLE['ref_a4_baseline_report']}) WHERE service_id = {_SID} UNION ALL SELECT branch_key, n, p50, p99 FROM ({e.ORACLE['ref_a4_branch_report']}) WHERE service_id = {_SID}")
def baselines(s, d):
    """Totals of a service, then of its branches."""
    own, branches = Engine(s, d).baselines(_chosen(s, d)[0])
    return own.select("service_id", "n", "p50", "p99").union(branches.select("branch_key", "n", "p50", "p99"))


@query("ref_api_stats", f"SELECT * FROM ({e.ORACLE['ref_a11_stats']}), ({e.ORACLE['ref_a13_topology_total']})")
def stats(s, d):
    return Engine(s, d).stats()


@query("ref_api_variant", f"SELECT * FROM ({e.ORACLE['ref_a11_by_variant']}) WHERE variant = 'cumulative:500'")
def variant(s, d):
    return Engine(s, d).variant("cumulative:500")


@query("ref_b18_combinations", f"SELECT v || ':' || t AS combination, v AS variant, t AS threshold FROM (SELECT unnest({VARIANTS}) AS v), (SELECT unnest({THRESHOLDS}) AS t)")
def b18(s, d):
    """All combinations of a variant and a threshold."""
    return s.createDataFrame([(c, c.split(":")[0], int(c.split(":")[1])) for c in combinations()], "combination string, variant string, threshold int")


@query("ref_s23_settings", "SELECT 'ewma:100' AS active")
def s23(s, d):
    """The active combination, chosen by one engine and read by the next."""
    kept = new_path(s, "settings")
    Engine(s, d, settings=kept).set_active("ewma:100")
    return s.createDataFrame([(Engine(s, d, settings=kept).active,)], "active string")


# --- streams -------------------------------------------------------------------------------------


@query("ref_s6_new_files", "SELECT batch_id, count(*) AS n FROM spans GROUP BY batch_id")
def s6(s, d):
    """Files of a folder read once each by a stream that is started twice, with files added between."""
    raw = table(s, d, "spans").select("trace_id", "batch_id")
    src, out, log = new_path(s, "landing"), new_path(s, "landed"), new_path(s, "landing-log")
    half = F.pmod("batch_id", F.lit(2)) == 0
    for part in (raw.filter(half), raw.filter(~half | F.col("batch_id").isNull())):
        part.write.mode("append").parquet(src)
        q = files.new_files(s, src, raw.schema).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
    return s.read.schema(raw.schema).parquet(out).groupBy("batch_id").agg(F.count("*").alias("n"))


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query("ref_z2_stream_assembly", f"WITH {ASM} SELECT trace_id, service_id, root_span_id, span_count, start_us, end_us, duration_us, has_error FROM asm")
def z2(s, d):
    """Traces of a stream in event time, from every delivered row; what is still open when the stream ends is flushed from its state."""
    u = usable_spans(table(s, d, "spans"), "operation_name", "duration", "tags", "service_name")
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    rows = u.select(
        trace_hex(F.col("th"), F.col("tl")).alias("trace_id"), span_hex(F.col("s")).alias("span_id"), F.coalesce(span_hex(F.col("p")), F.lit("")).alias("parent_id"), F.coalesce("operation_name", F.lit("")).alias("operation_name"),
        F.coalesce("service_name", F.lit("")).alias("service_name"), F.coalesce("event_us", F.lit(-1)).alias("start_time"), none("duration"), "tags", none("arrival"),
    )
    src, log, out = new_path(s, "span-stream"), new_path(s, "span-stream-log"), new_path(s, "stream-traces")
    rows.withColumn("ts", F.timestamp_micros("start_time")).write.option("compression", "zstd").parquet(src)
    schema = s.read.parquet(src).schema
    # the shuffles of a step go with it: they would lie beside those of all later steps
    conf = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: s.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        s.conf.set(k, v)
    try:
        stream = assembler.as_stored(files.new_files(s, src, schema, per_trigger=1 << 30)).withWatermark("ts", "1 hour")
        put = files.upsert_into(out, "trace_id", "span_count")

        def sink(spans, i, unique=True):
            with scratch(s):
                put(assembler.assembled(spans, unique=unique), i)

        q = assembler.completed_spans(stream, event_time=True).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
        drop(s, src)
        sink(assembler.pending_spans(s, log), 1_000_000, False)
    finally:
        for k, v in before.items():
            s.conf.set(k, v) if v else s.conf.unset(k)
    x = files.latest(s, out, "trace_id", "span_count")
    return x.select("trace_id", "service_id", "root_span_id", "span_count", "start_us", "end_us", "duration_us", "has_error")
