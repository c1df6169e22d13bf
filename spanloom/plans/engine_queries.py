"""The engine's own operators as queries over whole tables, each with its SQL for DuckDB where SQL can say it.

Names are those of the operator inventory: ``ref_<id>_<what>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.ids import trace_hex
from spanloom.functions.percentile import nearest_low_sorted
from spanloom.functions.spans import format_us, lookup, status
from spanloom.operators import assembly, fingerprint, graph, rollup, tree
from spanloom.operators.config import DIMENSIONS, OPERATION_KEYS, TAG_KEYS, Config
from spanloom.operators.traces import counting_rows
from spanloom.plans.pipeline_queries import _LAST, SPANS_SQL, _id
from spanloom.sources import cold, events, snapshots
from spanloom.sources.tables import table
from spanloom.workdir import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# --- shared SQL ----------------------------------------------------------------------------------

#: ``k``: valid spans. ``r``: traces that count, with a start. ``f``: findings of both tables.
K = f"""{SPANS_SQL},
k AS (SELECT t AS trace_id, s AS span_id, coalesce(p, '') AS parent_id, coalesce(operation_name, '') AS op, event_us AS st, duration AS dur,
             coalesce(tags, MAP {{}}::MAP(VARCHAR, VARCHAR)) AS tags, coalesce(service_name, '') AS svc FROM v WHERE event_us IS NOT NULL AND duration >= 0)"""
R = f"""{_LAST},
r AS (SELECT trace_id, service_id, fingerprint, span_count, duration_us, has_error, is_important, epoch_us(created_at) AS start_us FROM cr
      WHERE service_id IS NOT NULL AND fingerprint IS NOT NULL AND created_at IS NOT NULL AND duration_us IS NOT NULL)"""
FI = """f AS (SELECT DISTINCT 'anomaly' AS kind, id, trace_id, service_id, fingerprint, score, variant, created_at FROM anomalies UNION ALL
      SELECT DISTINCT 'deviation', id, trace_id, service_id, fingerprint, score, variant, created_at FROM deviations)"""
_STATUS = "CASE WHEN len(map_extract({t}, 'http.status_code')) > 0 THEN CASE WHEN coalesce({t}['http.status_code'], '') >= '400' THEN 'ERROR' ELSE 'OK' END WHEN len(map_extract({t}, 'error')) > 0 THEN 'ERROR' ELSE 'OK' END"
STATUS = _STATUS.format(t="tags")


def _lookup(keys: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(tags['{k}'], '')" for k in keys) + ", '')"


DIMS_SQL = {d: _lookup(k) for d, k in TAG_KEYS.items()}
DIMS_SQL["service_identity"] = f"coalesce(nullif({DIMS_SQL['service_identity']}, ''), svc)"
DIMS_SQL["operation"] = f"coalesce(nullif(op, ''), {_lookup(OPERATION_KEYS)})"
_FIRST = "first({x} ORDER BY parent_id <> '', st, span_id)"


def _some(d: str, keys: list[str]) -> str:
    v = _lookup(keys)
    return f"coalesce(nullif({_FIRST.format(x=v)}, ''), first({v} ORDER BY st, span_id) FILTER ({v} <> ''), '')"


_D = {d: _some(d, k) for d, k in TAG_KEYS.items()}
_D["service_identity"] = f"coalesce(nullif({_D['service_identity']}, ''), {_FIRST.format(x='svc')})"
_D["operation"] = f"coalesce(nullif({_FIRST.format(x='op')}, ''), {_some('operation', OPERATION_KEYS)})"
ASM = f"""{K},
asm0 AS (SELECT trace_id, {', '.join(f'{x} AS {d}' for d, x in _D.items())}, {_FIRST.format(x='span_id')} AS root_span_id, {_FIRST.format(x='svc')} AS rs, {_FIRST.format(x='op')} AS ro,
                count(*) AS span_count, min(st) AS start_us, greatest(max(st + dur), 0) AS end_us, bool_or({STATUS} = 'ERROR') AS has_error FROM k GROUP BY trace_id),
asm AS (SELECT trace_id, regexp_replace(concat_ws(':', {', '.join(DIMENSIONS)}), ':+$', '') AS service_id, {', '.join(DIMENSIONS)}, root_span_id, span_count, start_us, end_us, end_us - start_us AS duration_us, has_error FROM asm0)"""
EDGES = """e AS (SELECT c.trace_id, c.span_id, p.svc || ':' || p.op || '->' || c.svc || ':' || c.op AS branch_key, c.dur AS duration_us
      FROM k c JOIN k p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id WHERE c.parent_id <> '')"""


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- shared inputs -------------------------------------------------------------------------------


def spans(s: SparkSession, d: str) -> DataFrame:
    return assembly.valid_spans(table(s, d, "spans"))


def traces(s: SparkSession, d: str) -> DataFrame:
    """Traces that count, with all that learning needs: ``trace_id, service_id, fingerprint, span_count, duration_us, has_error, is_important, start_us``."""
    c = counting_rows(table(s, d, "traces"), "service_id", "fingerprint", "span_count", "duration_us", "has_error", "is_important", "created_at")
    out = c.select(trace_hex(F.col("th"), F.col("tl")).alias("trace_id"), "service_id", "fingerprint", "span_count", "duration_us", "has_error", "is_important", F.unix_micros("created_at").alias("start_us"))
    return out.filter("service_id is not null and fingerprint is not null and start_us is not null and duration_us is not null")


def findings(s: SparkSession, d: str) -> DataFrame:
    cols = ["id", "trace_id", "service_id", "fingerprint", "score", "variant", "created_at"]
    one = lambda kind, t: table(s, d, t).select(F.lit(kind).alias("kind"), *cols).distinct()
    return one("anomaly", "anomalies").unionByName(one("deviation", "deviations"))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row with all their columns."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


# --- sources and sinks ---------------------------------------------------------------------------


def _raw(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "spans")


def _json(df: DataFrame):
    return F.to_json(F.struct(F.col("trace_id").alias("TraceID"), F.col("span_id").alias("SpanID"), F.col("parent_id").alias("ParentID"), F.col("operation_name").alias("OperationName"), F.col("start_time").alias("StartTime"), F.col("duration").alias("Duration"), F.col("service_name").alias("ServiceName")))


@query("ref_s1_event_stream", "SELECT batch_id % 97 AS part, count(*) AS n, count(DISTINCT trace_id) AS traces, CAST(sum(duration) AS BIGINT) AS duration FROM (SELECT batch_id, trace_id, duration FROM spans) GROUP BY ALL")
def s1(s, d):
    """Every span as an event of a stream, between pings and comments, parsed back."""
    ev = _raw(s, d).select("batch_id", F.concat(F.lit("event: ping\ndata: {}\n\n: note\nevent:trace_batch\ndata: "), _json(None), F.lit("\n\nevent: end\ndata: x\n\n")).alias("value"))
    path = new_path(s, "sse")
    ev.select(F.pmod("batch_id", F.lit(97)).alias("part"), "value").write.partitionBy("part").option("lineSep", "\u001e").text(path)
    back = s.read.option("lineSep", "\u001e").text(path)
    x = events.span_batches(events.sse_events(back, "value", "part"), "part").filter("not bad")
    return x.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("TraceID").alias("traces"), F.sum("Duration").alias("duration")).withColumn("part", F.col("part").cast("bigint"))


@query("ref_s2_json_batches", "SELECT count(*) AS n, count(DISTINCT trace_id) AS traces, CAST(sum(duration) AS BIGINT) AS duration, 0 AS bad FROM spans")
def s2(s, d):
    """JSON texts, one span or an array of one, parsed as the ingest does."""
    text = _raw(s, d).select(F.when(F.pmod("batch_id", F.lit(2)) == 0, _json(None)).otherwise(F.concat(F.lit("["), _json(None), F.lit("]"))).alias("j"))
    return events.parse_batches(text, "j").agg(F.count("*").alias("n"), F.countDistinct("TraceID").alias("traces"), F.sum("Duration").alias("duration"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).cast("int").alias("bad"))


@query("ref_s3_accept", "SELECT trace_id, span_id, arrival FROM spans WHERE coalesce(trace_id, '') <> '' AND coalesce(span_id, '') <> ''")
def s3(s, d):
    return _raw(s, d).filter(events.accepted(None, "trace_id", "span_id")).select("trace_id", "span_id", "arrival")


@query("ref_s4_batch_report", "SELECT batch_id, count(*) FILTER (coalesce(trace_id, '') <> '' AND coalesce(span_id, '') <> '') AS accepted, count(*) FILTER (NOT (coalesce(trace_id, '') <> '' AND coalesce(span_id, '') <> '')) AS rejected FROM spans GROUP BY batch_id")
def s4(s, d):
    return events.batch_report(_raw(s, d), "batch_id", "trace_id", "span_id")


_REQ = "q AS (SELECT CAST(floor(batch_id / 16) AS BIGINT) AS request, count(*) AS n, count(*) FILTER (coalesce(trace_id, '') <> '' AND coalesce(span_id, '') <> '') AS ok FROM spans GROUP BY 1)"


@query("ref_s4_ingest_batches", f"WITH {_REQ} SELECT request, CASE WHEN n > 1000 THEN 0 ELSE ok END AS accepted, CASE WHEN n > 1000 THEN 0 ELSE n - ok END AS rejected, CASE WHEN n > 1000 THEN 'batch size exceeds maximum of 1000 spans' END AS error FROM q")
def s4_requests(s, d):
    """Requests of sixteen delivery batches each, as JSON arrays: those above the limit are refused whole."""
    # what lies above the limit is refused for its number alone, so no array needs more than one span beyond it
    one = _raw(s, d).withColumn("request", F.floor(F.col("batch_id") / 16)).withColumn("j", _json(None))
    n = F.row_number().over(Window.partitionBy("request").orderBy("batch_id", "arrival"))
    body = one.withColumn("_n", n).filter(F.col("_n") <= events.BATCH_LIMIT + 1).groupBy("request").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("body"))
    return events.ingest(body, "request", "body")[1]


@query(
    "ref_s9_trace_export",
    "SELECT trace_id, span_id, coalesce(parent_id, '') AS parent_id, coalesce(operation_name, '') AS operation_name, start_time, duration, coalesce(service_name, '') AS service_name, CASE WHEN duration % 3 = 0 THEN 'true' ELSE tags['http.method'] END AS mark FROM spans"
    " WHERE trace_id IS NOT NULL AND span_id IS NOT NULL AND start_time BETWEEN 0 AND 4000000000000000 AND duration BETWEEN 0 AND 4000000000000000 QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY arrival DESC) = 1",
)
def s9(s, d):
    """Spans as trace-export JSON, each twice in its text and as often as it was delivered: the last one counts. Null or negative times have no such text."""
    raw = _raw(s, d).filter("trace_id is not null and span_id is not null and start_time between 0 and 4000000000000000 and duration between 0 and 4000000000000000")
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    nano = lambda c: F.concat(c.cast("string"), F.lit("789"))
    span = lambda name: F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_id").alias("parentSpanId"), name.alias("name"), nano(F.col("start_time")).alias("startTimeUnixNano"),
        nano(F.col("start_time") + F.col("duration")).alias("endTimeUnixNano"), F.struct(F.when(F.pmod("duration", F.lit(3)) == 0, "2").otherwise("0").alias("code")).alias("status"), F.array(attr("http.method", F.col("tags")["http.method"])).alias("attributes"),
    )
    scope = F.struct(F.array(span(F.lit("before")), span(F.col("operation_name"))).alias("spans"))
    doc = F.struct(F.array(F.struct(F.struct(F.array(attr("service.name", F.col("service_name"))).alias("attributes")).alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))
    x = events.from_otlp(raw.select(F.to_json(doc).alias("value"), "arrival"), "value", "arrival")
    mark = F.coalesce(F.col("tags")["error"], F.nullif(F.col("tags")["http.method"], F.lit("")))
    return x.select("trace_id", "span_id", "parent_id", "operation_name", "start_time", "duration", "service_name", mark.alias("mark"))


@query(
    "ref_s5_export_scan",
    "SELECT coalesce(trace_id, '') AS trace_id, coalesce(span_id, '') AS span_id, coalesce(parent_id, '') AS parent_id, coalesce(operation_name, '') AS operation_name, start_time, duration, coalesce(service_name, '') AS service_name, tags['http.method'] AS method, tags['env'] AS env"
    " FROM spans WHERE coalesce(trace_id, '') <> '' AND coalesce(span_id, '') <> '' AND start_time > 0 AND duration >= 0",
)
def s5(s, d):
    ext = _raw(s, d).select("trace_id", "span_id", "parent_id", F.col("operation_name").alias("name"), F.col("start_time").alias("timestamp_micros"), F.col("duration").alias("duration_micros"), F.col("service_name").alias("local_endpoint_service_name"), F.col("tags")["http.method"].alias("http_method"), F.col("tags").alias("attributes"))
    x = events.from_export(ext)
    return x.select(*[c for c in x.columns if c != "tags"], F.col("tags")["http.method"].alias("method"), F.col("tags")["env"].alias("env"))


@query("ref_s7_bucket_layout", f"WITH {K} SELECT CAST(CAST('0x' || right(trace_id, 8) AS BIGINT) % 128 AS INT) AS bucket, count(*) AS n, CAST(sum(dur) AS BIGINT) AS duration FROM k WHERE st >= 1718150400000000 AND st < 1718236800000000 GROUP BY ALL")
def s7(s, d):
    """Folders by bucket and day, read back for one day with pruned partitions."""
    x = spans(s, d).select("trace_id", "start_time", "duration", cold.bucket_of(F.col("trace_id")).alias("bucket"))
    path = new_path(s, "layout")
    parts = {"year": "yyyy", "month": "MM", "day": "dd"}
    x = x.withColumns({k: F.date_format(F.timestamp_micros("start_time"), v) for k, v in parts.items()})
    x.repartition("bucket", *parts).write.partitionBy("bucket", *parts).parquet(path)
    back = s.read.parquet(path).filter("year = 2024 and month = 6 and day = 12")
    return back.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("duration").alias("duration"))


@query(
    "ref_s11_ingest_latency",
    "WITH x AS (SELECT service_name, batch_id, max(arrival) - min(arrival) AS spread, count(*) AS n FROM spans GROUP BY ALL) SELECT service_name, batch_id, n, round(avg(spread) OVER (PARTITION BY service_name ORDER BY batch_id ROWS 99 PRECEDING), 4) AS rolling FROM x",
)
def s11(s, d):
    """Counts per service and delivery batch with the rolling mean over the last hundred."""
    x = _raw(s, d).groupBy("service_name", "batch_id").agg((F.max("arrival") - F.min("arrival")).alias("spread"), F.count("*").alias("n"))
    w = Window.partitionBy("service_name").orderBy("batch_id").rowsBetween(-99, 0)
    return x.select("service_name", "batch_id", "n", F.round(F.avg("spread").over(w), 4).alias("rolling"))


@query("ref_s12_trace_upsert", f"WITH {_LAST} SELECT trace_id, service_id, fingerprint, span_count, duration_us, has_error FROM cr")
def s12(s, d):
    c = counting_rows(table(s, d, "traces"), "service_id", "fingerprint", "span_count", "duration_us", "has_error")
    return c.select(trace_hex(F.col("th"), F.col("tl")).alias("trace_id"), *c.columns[2:])


@query("ref_s13_important", f"WITH {_LAST}, {FI} SELECT trace_id FROM cr WHERE trace_id IN (SELECT trace_id FROM f)")
def s13(s, d):
    t = counting_rows(table(s, d, "traces")).select(trace_hex(F.col("th"), F.col("tl")).alias("trace_id"))
    return t.join(findings(s, d).select("trace_id"), "trace_id", "left_semi")


@query("ref_s14_interesting_upsert", f"WITH {FI} SELECT trace_id, kind AS reason, id, score FROM f QUALIFY row_number() OVER (PARTITION BY trace_id, kind ORDER BY created_at DESC, id DESC) = 1")
def s14(s, d):
    w = Window.partitionBy("trace_id", "kind").orderBy(F.desc("created_at"), F.desc("id"))
    return findings(s, d).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("trace_id", F.col("kind").alias("reason"), "id", "score")


_COLD = (1718236800000000, 1718323200000000)


@query("ref_s18_cold_scan", f"WITH {R} SELECT trace_id, service_id, duration_us, start_us FROM r WHERE start_us >= {_COLD[0]} AND start_us < {_COLD[1]}")
def s18(s, d):
    """Traces written as compressed JSON per hour, then read for one day."""
    x = traces(s, d).select("trace_id", "service_id", "duration_us", "start_us")
    path = new_path(s, "cold")
    cold.write_hours(x, "start_us", path)
    return cold.read_hours(s, path, x.schema, "start_us", *_COLD).select("trace_id", "service_id", "duration_us", "start_us")


@query("ref_s19_cold_stats")
def s19(s, d):
    x = traces(s, d).select("trace_id", "service_id", "duration_us", "start_us")
    path = new_path(s, "cold")
    cold.write_hours(x, "start_us", path)
    return cold.stored(s, path)


@query("ref_s16_cold_rollups")
def s16(s, d):
    """Rollups written to cold storage by hour of their window, then read for one day."""
    x = rollup.rollups(written(traces(s, d), "traces"))
    path = new_path(s, "cold-rollups")
    cold.write_hours(x, "window_start", path)
    return cold.read_hours(s, path, x.schema, "window_start", *_COLD).select(*x.columns)


@query("ref_s17_cold_interesting", f"WITH {FI}, {R} SELECT r.trace_id, kind AS reason, start_us, r.service_id FROM r JOIN (SELECT DISTINCT trace_id, kind FROM f) f USING (trace_id) WHERE start_us >= {_COLD[0]} AND start_us < {_COLD[1]}")
def s17(s, d):
    """Traces with findings, written to cold storage by hour, then read for one day."""
    f = findings(s, d).select("trace_id", F.col("kind").alias("reason")).distinct()
    x = traces(s, d).join(f, "trace_id").select("trace_id", "reason", "start_us", "service_id")
    path = new_path(s, "cold-interesting")
    cold.write_hours(x, "start_us", path)
    return cold.read_hours(s, path, x.schema, "start_us", *_COLD).select(*x.columns)


# --- projections and filters ---------------------------------------------------------------------


@query("ref_p1_valid_spans", f"WITH {K} SELECT trace_id, span_id, parent_id, op AS operation_name, st AS start_time, dur AS duration, svc AS service_name FROM k")
def p1(s, d):
    return spans(s, d).select("trace_id", "span_id", "parent_id", "operation_name", "start_time", "duration", "service_name")


@query(
    "ref_p2_known_tags",
    "SELECT trace_id, span_id, start_time, duration, coalesce(service_name, '') AS service_name, coalesce(tags['http.method'], 'GET') AS method, coalesce(tags['http.status_code'], CAST(duration AS VARCHAR)) AS code, tags['error'] AS error, coalesce(tags['env'], nullif(service_name, '')) AS env"
    " FROM spans WHERE coalesce(trace_id, '') <> '' AND coalesce(span_id, '') <> '' AND start_time > 0 AND duration >= 0",
)
def p2(s, d):
    """Tag columns of an export, dotted or with underscores, and identity columns; attributes win."""
    ext = _raw(s, d).select(
        "trace_id", "span_id", F.col("start_time").alias("timestamp_micros"), F.col("duration").alias("duration_micros"), F.col("service_name").alias("local_endpoint_service_name"),
        F.lit("GET").alias("http.method"), F.col("duration").alias("http_status_code"), F.col("service_name").alias("env"), F.col("tags").alias("attributes"),
    )
    t = F.col("tags")
    return events.from_export(ext).select("trace_id", "span_id", "start_time", "duration", "service_name", t["http.method"].alias("method"), t["http.status_code"].alias("code"), t["error"].alias("error"), t["env"].alias("env"))


@query("ref_p3_tag_lookup", f"WITH {K} SELECT trace_id, span_id, {', '.join(f'{_lookup(k)} AS {x}' for x, k in TAG_KEYS.items())} FROM k")
def p3(s, d):
    return spans(s, d).select("trace_id", "span_id", *[lookup(F.col("tags"), k).alias(x) for x, k in TAG_KEYS.items()])


@query("ref_p4_own_tag_keys", f"WITH {K} SELECT trace_id, span_id, {_lookup(['http.method', 'env'])} AS env, {DIMS_SQL['scope1']} AS scope1 FROM k")
def p4(s, d):
    """Grouping values by keys of one's own; a dimension with an empty list keeps the built-in ones."""
    own = Config().with_tags(env=["http.method", "env"], scope1=[])
    return spans(s, d).select("trace_id", "span_id", *[lookup(F.col("tags"), own.keys(x)).alias(x) for x in ("env", "scope1")])


@query("ref_p5_status", f"WITH {K} SELECT trace_id, span_id, {STATUS} AS status FROM k")
def p5(s, d):
    return spans(s, d).select("trace_id", "span_id", status(F.col("tags")).alias("status"))


@query("ref_p6_service_filter", f"WITH {R} SELECT service_id FROM service_groupings WHERE env = 'prod' AND scope2 = 'eu-lake' AND service_id IN (SELECT service_id FROM r)")
def p6(s, d):
    """The service list for an environment and a scope."""
    from spanloom.plans.api import Engine

    return Engine(s, d).services(env="prod", scope2="eu-lake").select("service_id")


@query("ref_p7_search", f"WITH {R} SELECT service_id, count(*) AS n FROM r GROUP BY service_id HAVING contains(lower(service_id), 'ledger') AND count(*) FILTER (has_error) > 0")
def p7(s, d):
    g = traces(s, d).filter(F.lower("service_id").contains("ledger")).groupBy("service_id").agg(F.count("*").alias("n"), F.count_if("has_error").alias("e"))
    return g.filter("e > 0").select("service_id", "n")


@query("ref_p8_facets", "SELECT DISTINCT 'scope1' AS facet, scope1 AS value FROM service_groupings WHERE coalesce(scope1, '') <> '' UNION ALL SELECT DISTINCT 'scope2', scope2 FROM service_groupings WHERE scope1 = 'tenant-pine-north' AND coalesce(scope2, '') <> '' UNION ALL SELECT DISTINCT 'env', env FROM service_groupings WHERE scope1 = 'tenant-pine-north' AND coalesce(env, '') <> ''")
def p8(s, d):
    from spanloom.plans.api import Engine

    e = Engine(s, d)
    return e.facets("scope1").unionByName(e.facets("scope2", scope1="tenant-pine-north")).unionByName(e.facets("env", scope1="tenant-pine-north")).distinct()


@query("ref_p9_min_score", f"WITH {FI} SELECT kind, id FROM f WHERE score >= 3.5 AND variant = 'cumulative:500' AND NOT isnan(score)")
def p9(s, d):
    return findings(s, d).filter("score >= 3.5 and variant = 'cumulative:500' and not isnan(score)").select("kind", "id")


@query("ref_p10_span_view", f"WITH {K} SELECT trace_id, span_id, parent_id AS parent_span_id, svc AS service_name, op AS operation_name, st AS start_time, dur AS duration_us, {STATUS} AS status FROM k")
def p10(s, d):
    return spans(s, d).select("trace_id", "span_id", F.col("parent_id").alias("parent_span_id"), "service_name", "operation_name", "start_time", F.col("duration").alias("duration_us"), status(F.col("tags")).alias("status"))


_NINE = ["service_identity", "scope1", "scope2", "scope3", "env", "feature_group", "feature_name", "sub_service", "operation"]


@query("ref_p11_split_service_id", "SELECT service_id, " + ", ".join(f"coalesce(string_split(service_id, ':')[{i + 1}], '') AS {c}" for i, c in enumerate(_NINE)) + ", string_split(service_id || ':a:b', ':')[10:] AS extra FROM service_groupings")
def p11(s, d):
    """Parts of a service id, two more than it has; what is beyond the ninth is left over."""
    parts = F.split("service_id", ":")
    cols = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(_NINE)]
    more = F.split(F.concat("service_id", F.lit(":a:b")), ":")
    return table(s, d, "service_groupings").select("service_id", *cols, F.slice(more, 10, 1 << 20).alias("extra"))


_NONE = " AND ".join(f"coalesce({c}, '') = ''" for c in _NINE)
_SOME = "SELECT CASE WHEN ascii(right(service_id, 1)) % 2 = 0 THEN service_id ELSE service_id || ':x' END AS service_id, " + ", ".join(f"CASE WHEN ascii(right(service_id, 1)) % 2 = 0 THEN {c} END AS {c}" for c in _NINE) + " FROM service_groupings"


@query("ref_p12_grouping_fallback", f"WITH g AS ({_SOME}) SELECT service_id, " + ", ".join(f"CASE WHEN {_NONE} THEN coalesce(string_split(service_id, ':')[{i + 1}], '') ELSE coalesce({c}, '') END AS {c}" for i, c in enumerate(_NINE)) + " FROM g")
def p12(s, d):
    """Stored parts of a service id; where all nine are absent (here for half of the ids) they are split from the id."""
    keep = F.pmod(F.ascii(F.substring("service_id", -1, 1)), F.lit(2)) == 0
    g = table(s, d, "service_groupings")
    g = g.select(F.when(keep, F.col("service_id")).otherwise(F.concat("service_id", F.lit(":x"))).alias("service_id"), *[F.when(keep, F.col(c)).alias(c) for c in _NINE])
    return g.select("service_id", *grouping_parts())


def grouping_parts():
    """The nine parts of ``service_id``: the stored ones, or, where all are null or empty, those of the id."""
    parts = F.split("service_id", ":")
    stored = [F.coalesce(F.col(c), F.lit("")) for c in _NINE]
    none = F.concat(*stored) == ""
    return [F.when(none, F.coalesce(F.get(parts, F.lit(i)), F.lit(""))).otherwise(x).alias(c) for i, (c, x) in enumerate(zip(_NINE, stored))]


@query("ref_p13_valid_for_view", "SELECT trace_id, span_id, arrival FROM spans WHERE span_id <> ''")
def p13(s, d):
    return _raw(s, d).filter("span_id <> ''").select("trace_id", "span_id", "arrival")


@query(
    "ref_p14_sanitize",
    "SELECT span_id, arrival, coalesce(trace_id, '') AS trace_id, coalesce(parent_id, '') AS parent_id, coalesce(nullif(service_name, ''), 'unknown-service') AS service_name, coalesce(nullif(operation_name, ''), 'unknown-operation') AS operation_name, greatest(coalesce(start_time, 0), 0) AS start_time, greatest(coalesce(duration, 0), 0) AS duration,"
    f" CASE WHEN tags IS NULL THEN 'OK' ELSE {STATUS} END AS status, CAST(coalesce(cardinality(tags), 0) AS BIGINT) AS n_tags FROM spans WHERE span_id <> '' AND NOT starts_with(span_id, 'unknown-')",
)
def p14(s, d):
    named = lambda c, x: F.coalesce(F.nullif(c, F.lit("")), F.lit(x)).alias(c)
    pos = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c)
    tags = F.coalesce("tags", F.expr("cast(map() as map<string,string>)"))
    ok = _raw(s, d).filter("span_id <> '' and not startswith(span_id, 'unknown-')")
    return ok.select(
        "span_id", "arrival", named("trace_id", ""), named("parent_id", ""), named("service_name", "unknown-service"), named("operation_name", "unknown-operation"), pos("start_time"), pos("duration"),
        status(tags).alias("status"), F.size(tags).cast("bigint").alias("n_tags"),
    )


# --- assembly ------------------------------------------------------------------------------------


@query("ref_t1_latest_copy", f"WITH {SPANS_SQL} SELECT t AS trace_id, s AS span_id, coalesce(p, '') AS parent_id, arrival, duration FROM v")
def t1(s, d):
    return assembly.latest_copies(_raw(s, d)).select("trace_id", "span_id", "parent_id", "arrival", "duration")


@query("ref_t2_assemble", f"WITH {ASM} SELECT * FROM asm")
def t2(s, d):
    """Root, bounds, error, grouping and service id of every trace."""
    return assembly.assemble(spans(s, d))


@query("ref_t8_late_spans", f"WITH {SPANS_SQL}, e AS (SELECT t, min(arrival) + 180000000 AS emitted FROM u GROUP BY t) SELECT u.t AS trace_id, count(*) AS n_late, max(arrival) AS last_arrival FROM u JOIN e ON u.t = e.t WHERE arrival > emitted GROUP BY u.t")
def t8(s, d):
    """Traces that would be emitted again: rows that arrive after the window that the first one opened."""
    from spanloom.sources.tables import usable_spans

    u = usable_spans(_raw(s, d)).select("th", "tl", "arrival")
    first = u.groupBy("th", "tl").agg((F.min("arrival") + F.lit(180_000_000)).alias("emitted"))
    late = u.join(first, ["th", "tl"]).filter("arrival > emitted").groupBy("th", "tl").agg(F.count("*").alias("n_late"), F.max("arrival").alias("last_arrival"))
    return late.select(trace_hex(F.col("th"), F.col("tl")).alias("trace_id"), "n_late", "last_arrival")


@query("ref_t9_assembler_stats", f"WITH {SPANS_SQL} SELECT (SELECT count(*) FROM spans) AS received, (SELECT count(*) FROM u) AS usable, (SELECT count(*) FROM v) AS spans, (SELECT count(DISTINCT t) FROM v) AS traces, (SELECT count(DISTINCT trace_id) FROM pending_traces) AS pending")
def t9(s, d):
    from spanloom.sources.tables import usable_spans

    raw = _raw(s, d)
    u = usable_spans(raw)
    per = u.groupBy("th", "tl", "s").agg(F.count("*").alias("n")).groupBy("th", "tl").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    a = per.agg(F.sum("n").alias("usable"), F.sum("m").alias("spans"), F.count("*").alias("traces"))
    return side_by_side(raw.agg(F.count("*").alias("received")), a, table(s, d, "pending_traces").agg(F.countDistinct("trace_id").alias("pending")))


# --- fingerprints and graphs ---------------------------------------------------------------------


@query("ref_f1_signature", f"WITH {K} SELECT trace_id, span_id, concat_ws('|', {', '.join(DIMS_SQL[x] for x in DIMENSIONS)}) AS signature FROM k")
def f1(s, d):
    return assembly.with_signature(spans(s, d)).select("trace_id", "span_id", "signature")


@query("ref_f2_fingerprints")
def f2(s, d):
    """Refined-label hash and canonical shape of every trace."""
    return fingerprint.fingerprints(spans(s, d))


@query("ref_f4_branches", f"WITH {K}, {EDGES} SELECT trace_id, span_id, branch_key, duration_us FROM e")
def f4(s, d):
    return assembly.edges(spans(s, d)).drop("is_error")


_REC = f"""WITH RECURSIVE {K},
w AS (SELECT trace_id, span_id, [svc || ':' || op] AS names, false AS rec, 0 AS depth FROM k c WHERE NOT EXISTS (SELECT 1 FROM k p WHERE p.trace_id = c.trace_id AND p.span_id = c.parent_id)
      UNION ALL SELECT c.trace_id, c.span_id, list_append(w.names, c.svc || ':' || c.op), list_contains(w.names, c.svc || ':' || c.op), w.depth + 1 FROM w JOIN k c ON c.trace_id = w.trace_id AND c.parent_id = w.span_id)"""


_LAST_ROOT = """lr AS (SELECT trace_id, arg_max(span_id, (st, span_id)) AS root FROM k WHERE parent_id = '' GROUP BY trace_id),
wr AS (SELECT k.trace_id, k.span_id, [svc || ':' || op] AS names, false AS rec FROM k JOIN lr ON lr.trace_id = k.trace_id AND lr.root = k.span_id
       UNION ALL SELECT c.trace_id, c.span_id, list_append(wr.names, c.svc || ':' || c.op), list_contains(wr.names, c.svc || ':' || c.op) FROM wr JOIN k c ON c.trace_id = wr.trace_id AND c.parent_id = wr.span_id)"""


@query("ref_f5_recursion", f"WITH RECURSIVE {K}, {_LAST_ROOT} SELECT k.trace_id, coalesce(bool_or(rec), false) AS recursive FROM k LEFT JOIN wr USING (trace_id, span_id) GROUP BY k.trace_id")
def f5(s, d):
    """Whether a name repeats on a path from the last root of the trace; false without a root."""
    return tree.tree_view(spans(s, d)).groupBy("trace_id").agg(F.bool_or("recursive").alias("recursive"))


_SETS = f"""WITH {K}, {EDGES}, {R}, b AS (SELECT trace_id, list_sort(list_distinct(list(branch_key))) AS keys FROM e GROUP BY trace_id),
x AS (SELECT r.trace_id, r.service_id, r.fingerprint, coalesce(b.keys, []) AS keys, r.start_us FROM r LEFT JOIN b USING (trace_id)),
n AS (SELECT service_id, fingerprint, count(*) AS n, first(keys ORDER BY start_us, trace_id) AS keys FROM x GROUP BY ALL),
c AS (SELECT service_id, keys AS canon FROM n QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY n DESC, fingerprint) = 1 AND n > 0.1 * sum(n) OVER (PARTITION BY service_id))"""


@query("ref_f6_branch_diff", f"{_SETS} SELECT trace_id, list_sort(list_filter(keys, lambda q: NOT list_contains(coalesce(canon, []), q))) AS added, list_sort(list_filter(coalesce(canon, []), lambda q: NOT list_contains(keys, q))) AS removed FROM x LEFT JOIN c USING (service_id)")
def f6(s, d):
    """Branches that a trace has beyond the first trace of its service's canonical path, and lacks."""
    keys = assembly.edges(spans(s, d)).groupBy("trace_id").agg(F.array_sort(F.collect_set("branch_key")).alias("keys"))
    none = F.expr("cast(array() as array<string>)")
    x = written(traces(s, d).join(keys, "trace_id", "left").select("trace_id", "service_id", "fingerprint", F.coalesce("keys", none).alias("keys"), "start_us"), "branch-sets")
    first = F.min(F.struct("start_us", "trace_id")).alias("first")
    n = x.groupBy("service_id", "fingerprint").agg(F.count("*").alias("n"), first)
    w = Window.partitionBy("service_id")
    top = n.select("*", F.row_number().over(w.orderBy(F.desc("n"), "fingerprint")).alias("_q"), F.sum("n").over(w).alias("_all")).filter("_q = 1 and n > 0.1 * _all")
    c = top.select("service_id", F.col("first.trace_id").alias("trace_id")).join(x.select("trace_id", F.col("keys").alias("canon")), "trace_id").drop("trace_id")
    canon = F.coalesce("canon", none)
    return x.join(c, "service_id", "left").select("trace_id", F.array_sort(F.array_except("keys", canon)).alias("added"), F.array_sort(F.array_except(canon, "keys")).alias("removed"))


@query("ref_f7_call_nodes", f"WITH {K} SELECT trace_id, svc || ':' || op AS node, count(*) AS n, CAST(sum(dur) AS BIGINT) AS duration_sum, CASE WHEN bool_or({STATUS} = 'OK') THEN 'OK' ELSE 'ERROR' END AS status, first(parent_id = '' ORDER BY st, span_id) AS is_root FROM k WHERE svc <> '' AND op <> '' GROUP BY ALL")
def f7(s, d):
    return graph.call_nodes(spans(s, d))


@query(
    "ref_f8_call_links",
    f"WITH {K} SELECT c.trace_id, p.svc || ':' || p.op AS source, c.svc || ':' || c.op AS target, count(*) AS n, first(c.dur ORDER BY c.st, c.span_id) AS first_duration FROM k c JOIN k p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id"
    " WHERE c.svc <> '' AND c.op <> '' AND p.svc <> '' AND p.op <> '' AND p.svc || ':' || p.op <> c.svc || ':' || c.op GROUP BY ALL",
)
def f8(s, d):
    return graph.call_links(spans(s, d))


@query("ref_f9_topology_cardinality")
def f9(s, d):
    """Shapes, mixes and sizes of each root; traces without exactly one root under a null root."""
    x = written(spans(s, d), "valid-spans")
    return graph.topology_cardinality(x, fingerprint.fingerprints(x))


@query(
    "ref_f9_mixes",
    f"WITH {K}, n AS (SELECT trace_id, svc || '|' || op AS name, count(*) AS n, count(*) FILTER (parent_id = '') AS roots FROM k GROUP BY ALL), p AS (SELECT trace_id, sum(roots) AS roots, max(name) FILTER (roots > 0) AS root, sum(n) AS size, md5(string_agg(name || ' ' || n, chr(10) ORDER BY name || ' ' || n)) AS mix FROM n GROUP BY trace_id)"
    " SELECT CASE WHEN roots = 1 THEN root END AS root, count(*) AS traces, count(DISTINCT CASE WHEN roots = 1 THEN mix END) AS mixes, count(DISTINCT CASE WHEN roots = 1 THEN size END) AS sizes FROM p GROUP BY 1",
)
def f9b(s, d):
    """The same without shapes."""
    return graph.topology_cardinality(spans(s, d))


@query("ref_f10_children", f"WITH {K} SELECT trace_id, parent_id, count(*) AS n, CAST(sum(dur) AS BIGINT) AS duration FROM k WHERE parent_id <> '' GROUP BY ALL")
def f10(s, d):
    return spans(s, d).filter("parent_id <> ''").groupBy("trace_id", "parent_id").agg(F.count("*").alias("n"), F.sum("duration").alias("duration"))


# --- views of one trace, for all traces ----------------------------------------------------------


#: ``sh``: canonical texts of the trees, from the deepest level up; all children of a span lie one level below it.
_SHAPES = """nd AS (SELECT w.trace_id, w.span_id, k.parent_id, w.depth, k.svc || '|' || k.op AS name FROM w JOIN k USING (trace_id, span_id)),
tx AS (SELECT trace_id, span_id, parent_id, depth, name || '()' AS text FROM nd WHERE depth = (SELECT max(depth) FROM nd)
       UNION ALL SELECT n.trace_id, n.span_id, any_value(n.parent_id), any_value(n.depth), any_value(n.name) || '(' || coalesce(string_agg(c.text, '' ORDER BY c.text), '') || ')'
       FROM nd n LEFT JOIN tx c ON c.trace_id = n.trace_id AND c.parent_id = n.span_id WHERE n.depth = (SELECT max(depth) - 1 FROM tx) GROUP BY n.trace_id, n.span_id),
sh AS (SELECT k.trace_id, md5(coalesce(string_agg(tx.text, '' ORDER BY tx.text), '')) AS shape FROM (SELECT DISTINCT trace_id FROM k) k LEFT JOIN tx ON tx.trace_id = k.trace_id AND tx.depth = 0 GROUP BY k.trace_id)"""


@query("ref_f3_shapes", f"{_REC}, {_SHAPES} SELECT trace_id, shape FROM sh")
def f3(s, d):
    """Canonical shape of every trace; spans in circles are no part of it."""
    return fingerprint.fingerprints(spans(s, d)).select("trace_id", "shape")


#: Spans on or below a circle: how many different spans the way up from each meets.
_ROUND = """lo AS (SELECT k.trace_id, k.span_id, k.parent_id FROM k ANTI JOIN w USING (trace_id, span_id)),
ro AS (SELECT trace_id, span_id, parent_id AS x, [span_id] AS seen FROM lo UNION ALL SELECT ro.trace_id, ro.span_id, lo.parent_id, list_append(ro.seen, lo.span_id) FROM ro JOIN lo ON lo.trace_id = ro.trace_id AND lo.span_id = ro.x WHERE NOT list_contains(ro.seen, ro.x)),
dp AS (SELECT trace_id, span_id, least(depth, 100) AS depth, false AS circular, rec FROM w UNION ALL SELECT trace_id, span_id, CAST(least(max(len(seen)), 100) AS INT), true, false FROM ro GROUP BY trace_id, span_id)"""


@query("ref_w1_depth", f"{_REC}, {_ROUND} SELECT trace_id, span_id, depth FROM dp")
def w1(s, d):
    """Depth of all spans; on or below a circle the number of spans that the way up meets."""
    return tree.tree_view(spans(s, d)).select("trace_id", "span_id", "depth")


#: All ways down from the roots (from every span where there is none); a way ends where it would meet itself or gets too deep, which counts nothing.
_WAYS = """sp AS (SELECT trace_id, span_id FROM w WHERE depth = 0 UNION ALL SELECT trace_id, span_id FROM k WHERE trace_id NOT IN (SELECT trace_id FROM w)),
wy AS (SELECT k.trace_id, k.span_id, k.dur AS total, [k.span_id] AS path, [(k.st, k.span_id)] AS ord, 0 AS depth, false AS done FROM k JOIN sp USING (trace_id, span_id)
       UNION ALL SELECT c.trace_id, c.span_id, CASE WHEN list_contains(path, c.span_id) OR depth >= 100 THEN total ELSE total + c.dur END, CASE WHEN list_contains(path, c.span_id) OR depth >= 100 THEN path ELSE list_append(path, c.span_id) END,
              list_append(ord, (c.st, c.span_id)), depth + 1, list_contains(path, c.span_id) OR depth >= 100 FROM wy JOIN k c ON c.trace_id = wy.trace_id AND c.parent_id = wy.span_id WHERE NOT done),
be AS (SELECT trace_id, total, path FROM wy WHERE done OR NOT EXISTS (SELECT 1 FROM k WHERE k.trace_id = wy.trace_id AND k.parent_id = wy.span_id) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY total DESC, ord) = 1)"""


@query("ref_w2_critical_sum", f"{_REC}, {_WAYS} SELECT trace_id, total AS critical_us FROM be")
def w2(s, d):
    """Length of every trace's critical path, from the flagged spans."""
    x = written(spans(s, d), "valid-spans")
    flags = tree.tree_view(x).filter("critical").select("trace_id", "span_id")
    return x.join(flags, ["trace_id", "span_id"]).groupBy("trace_id").agg(F.sum("duration").alias("critical_us"))


@query("ref_w2_critical_path", f"{_REC}, {_WAYS} SELECT trace_id, unnest(path) AS span_id FROM be")
def w2b(s, d):
    return tree.tree_view(spans(s, d)).filter("critical").select("trace_id", "span_id")


_T = "x AS (SELECT trace_id, span_id, st, dur, min(st) OVER w AS lo, max(st + dur) OVER w - min(st) OVER w AS total, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY trace_id))"


@query("ref_w3_timing", f"WITH {K}, {_T} SELECT trace_id, span_id, CASE WHEN total > 0 THEN round(greatest(0, least(100, (st - lo) * 100.0::DOUBLE / total)), 6) ELSE 0 END AS offset_pct, CASE WHEN total > 0 THEN round(greatest(0.5, least(100, dur * 100.0::DOUBLE / total)), 6) ELSE round(100.0::DOUBLE / n, 6) END AS width_pct FROM x")
def w3(s, d):
    t = tree.timing(spans(s, d))
    return t.select("trace_id", "span_id", F.round("offset_pct", 6).alias("offset_pct"), F.round("width_pct", 6).alias("width_pct"))


@query("ref_w4_trace_duration", f"WITH {K} SELECT trace_id, greatest(max(st + dur) - min(st), 0) AS duration_us FROM k GROUP BY trace_id")
def w4(s, d):
    return spans(s, d).groupBy("trace_id").agg(F.greatest(F.max(F.col("start_time") + F.col("duration")) - F.min("start_time"), F.lit(0)).alias("duration_us"))


@query("ref_w5_circular", f"{_REC} SELECT trace_id, span_id FROM k ANTI JOIN w USING (trace_id, span_id)")
def w5(s, d):
    return tree.tree_view(spans(s, d)).filter("circular").select("trace_id", "span_id")


@query("ref_w6_span_tree", f"{_REC} SELECT k.trace_id, k.span_id, CASE WHEN w.depth BETWEEN 1 AND 99 THEN k.parent_id ELSE '' END AS shown_below FROM k LEFT JOIN w USING (trace_id, span_id)")
def w6(s, d):
    """Span below which each span is shown; orphans, spans on or below a circle and those too deep are roots."""
    x = written(spans(s, d), "valid-spans")
    # only a span with a parent in its trace has a depth
    linked = tree.tree_view(x).filter(~F.col("circular") & F.col("depth").between(1, tree.MAX_DEPTH - 1)).select("trace_id", "span_id", F.lit(True).alias("_linked"))
    below = F.when(F.col("_linked"), F.col("parent_id")).otherwise("")
    return x.join(linked, ["trace_id", "span_id"], "left").select("trace_id", "span_id", below.alias("shown_below"))


_OFFSET = "CASE WHEN total > 0 THEN round(greatest(0, least(100, (st - lo) * 100.0::DOUBLE / total)), 6) ELSE 0 END AS offset_pct, CASE WHEN total > 0 THEN round(greatest(0.5, least(100, dur * 100.0::DOUBLE / total)), 6) ELSE round(100.0::DOUBLE / n, 6) END AS width_pct"


@query(
    "ref_w7_waterfall",
    f"{_REC}, {_ROUND}, {_WAYS}, {_LAST_ROOT}, {_T}, cp AS (SELECT trace_id, unnest(path) AS span_id, true AS critical FROM be), bs AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY st, span_id) AS INT) AS row FROM k)"
    f" SELECT bs.trace_id, bs.span_id, bs.row, bs.svc AS service_name, bs.op AS operation_name, bs.dur AS duration, {_STATUS.format(t='bs.tags')} AS status, dp.depth, dp.circular, coalesce(cp.critical, false) AS critical, coalesce(wr.rec, false) AS recursive, {_OFFSET.replace('st -', 'x.st -').replace('dur *', 'x.dur *')}"
    " FROM bs JOIN dp USING (trace_id, span_id) JOIN x USING (trace_id, span_id) LEFT JOIN cp USING (trace_id, span_id) LEFT JOIN wr USING (trace_id, span_id)",
)
def w7(s, d):
    """Rows of the waterfall: order, depth, bar and flags of every span."""
    x = written(spans(s, d), "valid-spans")
    row = F.row_number().over(Window.partitionBy("trace_id").orderBy("start_time", "span_id")).alias("row")
    base = x.select("trace_id", "span_id", row, "service_name", "operation_name", "duration", status(F.col("tags")).alias("status"))
    bars = tree.timing(x).select("trace_id", "span_id", *[F.round(c, 6).alias(c) for c in ("offset_pct", "width_pct")])
    return base.join(tree.tree_view(x), ["trace_id", "span_id"]).join(bars, ["trace_id", "span_id"])


def _shown(hundredth: int, unit: str) -> str:
    h = f"((dur + {hundredth // 2}) // {hundredth})"
    return f"CAST({h} // 100 AS VARCHAR) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0') || '{unit}'"


@query("ref_w8_format", f"WITH {K} SELECT trace_id, span_id, CASE WHEN dur <= 0 THEN '0.00ms' WHEN dur < 1000000 THEN {_shown(10, 'ms')} WHEN dur < 60000000 THEN {_shown(10_000, 's')} ELSE {_shown(600_000, 'm')} END AS shown FROM k")
def w8(s, d):
    """Durations as text, of all spans, by whole-number arithmetic."""
    return spans(s, d).select("trace_id", "span_id", format_us(F.col("duration")).alias("shown"))


@query("ref_w9_axis", f"WITH {K}, t AS (SELECT trace_id, max(st + dur) - min(st) AS total FROM k GROUP BY trace_id) SELECT trace_id, CAST(i AS INT) AS tick, total * i / 4.0::DOUBLE AS at_us FROM t, range(5) g(i)")
def w9(s, d):
    return tree.axis_ticks(spans(s, d))


# --- aggregations --------------------------------------------------------------------------------


def in_ring(n: str, seq: str, limit: int):
    """Whether the ``seq``-th of ``n`` samples is in the ring: all up to the limit; then the last ones, where the first stays until ``2 * limit``."""
    n, seq = F.col(n), F.col(seq)
    return (n <= limit) | ((n < 2 * limit) & ((seq == 1) | (seq > n - (limit - 1)))) | ((n >= 2 * limit) & (seq > n - limit))


def _in_ring_sql(limit: int) -> str:
    return f"(n_all <= {limit} OR (n_all < {2 * limit} AND (seq = 1 OR seq > n_all - {limit - 1})) OR (n_all >= {2 * limit} AND seq > n_all - {limit}))"


_RANKED = "x AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY start_us, trace_id) AS seq, count(*) OVER (PARTITION BY {k}) AS n_all FROM {t})"
_PCT = "list_sort(list({x}))[CAST(floor((count(*) - 1) * {p}) AS INT) + 1]"


def _ring_of(df: DataFrame, key: list[str], value: str, limit: int) -> DataFrame:
    """``key, samples``: the ring of each key, sorted. Only the kept rows are gathered, so an array has at most ``limit`` values."""
    x = rollup.numbered(df, key, ["start_us", "trace_id"], "start_us")
    return x.filter(in_ring("n_all", "seq", limit)).groupBy(*key).agg(F.sort_array(F.collect_list(value)).alias("samples"))


@query(
    "ref_a1_services",
    f"""WITH {R}, {FI}, {_RANKED.format(k='service_id', t='r')},
    s AS (SELECT service_id, {_PCT.format(x='duration_us', p=0.5)} AS p50, {_PCT.format(x='duration_us', p=0.75)} AS p75 FROM x WHERE {_in_ring_sql(1000)} GROUP BY service_id),
    m AS (SELECT service_id, count(*) AS trace_count, count(DISTINCT fingerprint) AS topology_count, round(count(*) FILTER (has_error) / count(*)::DOUBLE, 9) AS error_rate, max(start_us) AS last_seen FROM r GROUP BY service_id),
    i AS (SELECT service_id, count(*) FILTER (kind = 'deviation') AS deviation_count, count(*) FILTER (kind = 'anomaly') AS anomaly_count FROM f GROUP BY service_id)
    SELECT m.*, p50, p75, coalesce(deviation_count, 0) AS deviation_count, coalesce(anomaly_count, 0) AS anomaly_count FROM m JOIN s USING (service_id) LEFT JOIN i USING (service_id)""",
)
def a1(s, d):
    """Service list: counts, error rate, percentiles of the sample ring, findings."""
    t = written(traces(s, d), "traces")
    m = t.groupBy("service_id").agg(F.count("*").alias("trace_count"), F.countDistinct("fingerprint").alias("topology_count"), F.round(F.count_if("has_error") / F.count("*"), 9).alias("error_rate"), F.max("start_us").alias("last_seen"))
    ring = _ring_of(t, ["service_id"], "duration_us", 1000)
    return (
        m.join(ring, "service_id")
        .join(a10(s, d), "service_id", "left")
        .select(*m.columns, nearest_low_sorted(F.col("samples"), 0.5).alias("p50"), nearest_low_sorted(F.col("samples"), 0.75).alias("p75"), F.coalesce("deviation_count", F.lit(0)).alias("deviation_count"), F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"))
    )


@query("ref_a3_topologies", f"WITH {R}, n AS (SELECT service_id, fingerprint, count(*) AS n, first(duration_us ORDER BY start_us, trace_id) AS avg_duration_us FROM r GROUP BY ALL) SELECT service_id, fingerprint, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY service_id), 6) AS percentage, avg_duration_us, row_number() OVER (PARTITION BY service_id ORDER BY n DESC, fingerprint) = 1 AND n > 0.1 * sum(n) OVER (PARTITION BY service_id) AS is_canonical FROM n")
def a3(s, d):
    """Paths of each service with share, the duration of their first trace and the canonical one."""
    n = traces(s, d).groupBy("service_id", "fingerprint").agg(F.count("*").alias("n"), F.min_by("duration_us", F.struct("start_us", "trace_id")).alias("avg_duration_us"))
    w = Window.partitionBy("service_id")
    total = F.sum("n").over(w)
    top = F.row_number().over(w.orderBy(F.desc("n"), "fingerprint"))
    return n.select("service_id", "fingerprint", "n", F.round(F.col("n") * F.lit(100.0) / total, 6).alias("percentage"), "avg_duration_us", ((top == 1) & (F.col("n") > F.lit(0.1) * total)).alias("is_canonical"))


@query(
    "ref_a4_baseline_report",
    f"WITH {R}, {_RANKED.format(k='service_id', t='r')}, s AS (SELECT service_id, {', '.join(_PCT.format(x='duration_us', p=p) + f' AS p{int(p * 100)}' for p in (0.5, 0.9, 0.99))} FROM x WHERE {_in_ring_sql(1000)} GROUP BY service_id)"
    " SELECT m.service_id, n, mean, duration_min, duration_max, p50, p90, p99 FROM (SELECT service_id, count(*) AS n, round(sum(duration_us) / count(*)::DOUBLE, 6) AS mean, min(duration_us) AS duration_min, max(duration_us) AS duration_max FROM r GROUP BY service_id) m JOIN s USING (service_id)",
)
def a4(s, d):
    t = written(traces(s, d), "traces")
    m = t.groupBy("service_id").agg(F.count("*").alias("n"), F.round(F.sum("duration_us") / F.count("*"), 6).alias("mean"), F.min("duration_us").alias("duration_min"), F.max("duration_us").alias("duration_max"))
    r = _ring_of(t, ["service_id"], "duration_us", 1000)
    return m.join(r, "service_id").select(*m.columns, *[nearest_low_sorted(F.col("samples"), p).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)])


_BR = f"{K}, {EDGES}, {R}, b AS (SELECT r.service_id, e.branch_key, e.duration_us, r.start_us, e.trace_id || e.span_id AS trace_id FROM e JOIN r USING (trace_id))"


@query(
    "ref_a4_branch_report",
    f"WITH {_BR}, {_RANKED.format(k='service_id, branch_key', t='b')}, s AS (SELECT service_id, branch_key, {', '.join(_PCT.format(x='duration_us', p=p) + f' AS p{int(p * 100)}' for p in (0.5, 0.9, 0.99))} FROM x WHERE {_in_ring_sql(100)} GROUP BY ALL)"
    " SELECT m.*, p50, p90, p99 FROM (SELECT service_id, branch_key, count(*) AS n, round(sum(duration_us) / count(*)::DOUBLE, 6) AS mean, min(duration_us) AS duration_min, max(duration_us) AS duration_max FROM b GROUP BY ALL) m JOIN s USING (service_id, branch_key)",
)
def a4b(s, d):
    """Branches of each service with percentiles of their rings."""
    t = traces(s, d).select("trace_id", "service_id", "start_us")
    b = assembly.edges(spans(s, d)).join(t, "trace_id").select("service_id", "branch_key", "duration_us", "start_us", F.concat("trace_id", "span_id").alias("trace_id"))
    b = written(b, "branches")
    key = ["service_id", "branch_key"]
    m = b.groupBy(*key).agg(F.count("*").alias("n"), F.round(F.sum("duration_us") / F.count("*"), 6).alias("mean"), F.min("duration_us").alias("duration_min"), F.max("duration_us").alias("duration_max"))
    r = _ring_of(b, key, "duration_us", 100)
    return m.join(r, key).select(*m.columns, *[nearest_low_sorted(F.col("samples"), p).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)])


@query("ref_a5_percentiles", f"WITH {R}, h AS (SELECT service_id, start_us // 3600000000 AS hour, list_sort(list(duration_us)) AS x FROM r GROUP BY ALL) SELECT service_id, hour, " + ", ".join(f"x[CAST(floor((len(x) - 1) * {p}) AS INT) + 1] AS p{int(p * 100)}" for p in (0, 0.25, 0.5, 0.75, 0.9, 0.99, 1)) + " FROM h")
def a5(s, d):
    """The engine's percentile rule over the traces of each service and hour."""
    hour = ((F.col("start_us") - F.pmod("start_us", F.lit(3_600_000_000))) / F.lit(3_600_000_000)).cast("bigint").alias("hour")
    w = Window.partitionBy("service_id", "hour")
    # ranks in a spilling sort: a busy hour is never gathered into an array
    x = traces(s, d).select("service_id", hour, "duration_us", "trace_id")
    x = x.withColumns({"_r": F.row_number().over(w.orderBy("duration_us", "trace_id")), "_n": F.count("*").over(w)})
    at = lambda p: F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) * F.lit(float(p))) + 1, F.col("duration_us"))).alias(f"p{int(p * 100)}")
    return x.groupBy("service_id", "hour").agg(*[at(p) for p in (0, 0.25, 0.5, 0.75, 0.9, 0.99, 1)])


@query(
    "ref_a6_weighted_percentile",
    f"WITH {R}, x AS (SELECT service_id, duration_us AS v, CAST(span_count AS DOUBLE) AS w, sum(CAST(span_count AS DOUBLE)) OVER (PARTITION BY service_id ORDER BY duration_us, span_count, trace_id ROWS UNBOUNDED PRECEDING) AS cum, sum(CAST(span_count AS DOUBLE)) OVER (PARTITION BY service_id) AS total FROM r WHERE span_count IS NOT NULL)"
    " SELECT service_id, coalesce(min(v) FILTER (cum > (total - 1) * 0.75), max(v)) AS p75 FROM x GROUP BY service_id",
)
def a6(s, d):
    """Durations weighted by the number of spans: running weights in a window, no gathering."""
    t = traces(s, d).filter("span_count is not null").select("service_id", "trace_id", "duration_us", F.col("span_count").cast("double").alias("w"))
    by = Window.partitionBy("service_id")
    # equal durations are added up before the window
    x = t.groupBy("service_id", "duration_us").agg(F.sum("w").alias("w"))
    x = x.select("service_id", "duration_us", F.sum("w").over(by.orderBy("duration_us").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("w").over(by).alias("total"))
    return x.groupBy("service_id").agg(F.coalesce(F.min(F.when(F.col("cum") > (F.col("total") - 1) * F.lit(0.75), F.col("duration_us"))), F.max("duration_us")).alias("p75"))


_ROLL = f"""{R}, w AS (SELECT *, start_us - start_us % 900000000 AS window_start FROM r),
ro AS (SELECT window_start, service_id, fingerprint, count(*) AS trace_count, CAST(sum(span_count) AS BIGINT) AS span_count, count(*) FILTER (has_error) AS error_count, CAST(sum(duration_us) AS BIGINT) AS duration_sum, min(duration_us) AS duration_min, max(duration_us) AS duration_max,
       {_PCT.format(x='duration_us', p=0.5)} AS p50, {_PCT.format(x='duration_us', p=0.99)} AS p99, list(trace_id ORDER BY start_us, trace_id)[:10] AS sample_trace_ids FROM w GROUP BY ALL)"""


ORACLE["ref_s16_cold_rollups"] = f"WITH {_ROLL} SELECT * FROM ro WHERE window_start >= {_COLD[0]} AND window_start < {_COLD[1]}"


ORACLE["ref_f9_topology_cardinality"] = (
    f"{_REC}, {_SHAPES}, n AS (SELECT trace_id, svc || '|' || op AS name, count(*) AS n, count(*) FILTER (parent_id = '') AS roots FROM k GROUP BY ALL), p AS (SELECT trace_id, sum(roots) AS roots, max(name) FILTER (roots > 0) AS root, sum(n) AS size, md5(string_agg(name || ' ' || n, chr(10) ORDER BY name || ' ' || n)) AS mix FROM n GROUP BY trace_id)"
    " SELECT CASE WHEN roots = 1 THEN root END AS root, count(*) AS traces, count(DISTINCT CASE WHEN roots = 1 THEN mix END) AS mixes, count(DISTINCT CASE WHEN roots = 1 THEN size END) AS sizes, count(DISTINCT CASE WHEN roots = 1 THEN shape END) AS shapes FROM p JOIN sh USING (trace_id) GROUP BY 1"
)


@query("ref_a7_rollup", f"WITH {_ROLL} SELECT * FROM ro")
def a7(s, d):
    return rollup.rollups(written(traces(s, d), "traces"))


@query("ref_a8_branch_stats", f"WITH {K}, {R} SELECT start_us - start_us % 900000000 AS window_start, service_id, fingerprint, svc || ':' || op AS branch, count(*) AS n, CAST(sum(dur) AS BIGINT) AS duration_sum, min(dur) AS duration_min, max(dur) AS duration_max, count(*) FILTER ({STATUS} = 'ERROR') AS error_count FROM k JOIN r USING (trace_id) GROUP BY ALL")
def a8(s, d):
    return rollup.branch_stats(spans(s, d), traces(s, d))


_BRANCHES = f"bs AS (SELECT start_us - start_us % 900000000 AS window_start, service_id, fingerprint, svc || ':' || op AS branch, count(*) AS n, CAST(sum(dur) AS BIGINT) AS duration_sum, min(dur) AS duration_min, max(dur) AS duration_max, count(*) FILTER ({STATUS} = 'ERROR') AS error_count FROM k JOIN r USING (trace_id) GROUP BY ALL)"


@query("ref_a8_branch_maps", f"WITH {K}, {R}, {_BRANCHES} SELECT window_start, service_id, fingerprint, list_sort(list(concat_ws('|', branch, n, duration_sum, duration_min, duration_max, error_count))) AS branches FROM bs GROUP BY ALL")
def a8b(s, d):
    """Branch statistics as one map per rollup, its entries written out."""
    m = F.map_entries("branch_stats")
    text = F.transform(m, lambda e: F.concat_ws("|", e["key"], *[e["value"][c].cast("string") for c in ("n", "duration_sum", "duration_min", "duration_max", "error_count")]))
    return rollup.as_map(a8(s, d)).select("window_start", "service_id", "fingerprint", F.array_sort(text).alias("branches"))


@query("ref_a9_branch_merge", f"WITH {K}, {R}, {_BRANCHES} SELECT * FROM bs")
def a9_branches(s, d):
    """Branch statistics of five minutes each, merged into those of their windows."""
    parts = rollup.branch_stats(spans(s, d), traces(s, d), 300_000_000)
    return rollup.merge_branches(parts.withColumn("window_start", F.col("window_start") - F.pmod("window_start", F.lit(rollup.WINDOW_US))))


_PARTS = f"""{R}, pt AS (SELECT start_us - start_us % 300000000 AS part, service_id, fingerprint, count(*) AS n, sum(span_count) AS spans, count(*) FILTER (has_error) AS errors, sum(duration_us) AS total, min(duration_us) AS low, max(duration_us) AS high,
       {_PCT.format(x='duration_us', p=0.5)} AS p50, {_PCT.format(x='duration_us', p=0.99)} AS p99, list(trace_id ORDER BY start_us, trace_id)[:10] AS ids FROM r GROUP BY ALL),
gr AS (SELECT part - part % 900000000 AS window_start, service_id, fingerprint, sum(n) AS trace_count, sum(spans) AS span_count, sum(errors) AS error_count, sum(total) AS duration_sum, min(low) AS duration_min, max(high) AS duration_max,
       list({{'n': n, 'p50': p50, 'p99': p99}} ORDER BY part) AS seq, flatten(list(ids ORDER BY part))[:10] AS sample_trace_ids FROM pt GROUP BY ALL),
fo AS (SELECT *, list_reduce(seq, lambda a, b: {{'n': a.n + b.n, 'p50': (a.p50 * a.n + b.p50 * b.n) // (a.n + b.n), 'p99': (a.p99 * a.n + b.p99 * b.n) // (a.n + b.n)}}) AS m FROM gr)"""


@query(
    "ref_a9_rollup_merge",
    f"WITH {_PARTS} SELECT window_start, service_id, fingerprint, CAST(trace_count AS BIGINT) AS trace_count, CAST(span_count AS BIGINT) AS span_count, CAST(error_count AS BIGINT) AS error_count, CAST(duration_sum AS BIGINT) AS duration_sum, duration_min, duration_max, m.p50 AS p50, m.p99 AS p99, sample_trace_ids FROM fo",
)
def a9(s, d):
    """Rollups of five minutes each, merged in their order into those of their windows."""
    parts = rollup.rollups(written(traces(s, d), "traces"), 300_000_000).withColumn("at", F.col("window_start"))
    return rollup.merge(parts.withColumn("window_start", F.col("at") - F.pmod("at", F.lit(rollup.WINDOW_US))), "at")


@query("ref_a10_issue_counts", f"WITH {FI} SELECT service_id, count(*) FILTER (kind = 'deviation') AS deviation_count, count(*) FILTER (kind = 'anomaly') AS anomaly_count FROM f GROUP BY service_id")
def a10(s, d):
    return findings(s, d).groupBy("service_id").agg(F.count_if(F.col("kind") == "deviation").alias("deviation_count"), F.count_if(F.col("kind") == "anomaly").alias("anomaly_count"))


@query("ref_a11_stats", f"WITH {_LAST}, {FI} SELECT (SELECT count(*) FROM cr) AS traces, (SELECT CAST(sum(span_count) AS BIGINT) FROM cr) AS spans, (SELECT count(*) FROM cr WHERE has_error) AS errors, (SELECT count(*) FROM f WHERE kind = 'deviation') AS deviations, (SELECT count(*) FROM f WHERE kind = 'anomaly') AS anomalies, (SELECT count(DISTINCT trace_id) FROM f) AS interesting")
def a11(s, d):
    c = counting_rows(table(s, d, "traces"), "span_count", "has_error").agg(F.count("*").alias("traces"), F.sum("span_count").alias("spans"), F.count_if("has_error").alias("errors"))
    f = findings(s, d).agg(F.count_if(F.col("kind") == "deviation").alias("deviations"), F.count_if(F.col("kind") == "anomaly").alias("anomalies"), F.countDistinct("trace_id").alias("interesting"))
    return side_by_side(c, f)


@query("ref_a11_by_variant", f"WITH {FI} SELECT variant, count(*) FILTER (kind = 'deviation') AS deviations, count(*) FILTER (kind = 'anomaly') AS anomalies, count(DISTINCT trace_id) AS traces FROM f GROUP BY variant")
def a11b(s, d):
    return findings(s, d).groupBy("variant").agg(F.count_if(F.col("kind") == "deviation").alias("deviations"), F.count_if(F.col("kind") == "anomaly").alias("anomalies"), F.countDistinct("trace_id").alias("traces"))


@query("ref_a12_interesting_share", f"WITH {_LAST}, {FI} SELECT count(DISTINCT trace_id) AS interesting, round(count(DISTINCT trace_id) * 100.0::DOUBLE / (SELECT count(*) FROM cr), 6) AS pct FROM f")
def a12(s, d):
    n = counting_rows(table(s, d, "traces")).agg(F.count("*").alias("n"))
    return side_by_side(findings(s, d).agg(F.countDistinct("trace_id").alias("interesting")), n).select("interesting", F.round(F.col("interesting") * F.lit(100.0) / F.nullif("n", F.lit(0)), 6).alias("pct"))


@query("ref_a13_topology_total", f"WITH {R} SELECT count(*) AS topologies FROM (SELECT DISTINCT service_id, fingerprint FROM r)")
def a13(s, d):
    return traces(s, d).select("service_id", "fingerprint").distinct().agg(F.count("*").alias("topologies"))


_HOUR = f"{R}, h AS (SELECT strftime(make_timestamp(start_us), '%Y-%m-%d-%H') AS hour, service_id, fingerprint, count(*) AS n, CAST(sum(duration_us) AS BIGINT) AS duration_sum, min(duration_us) AS duration_min, max(duration_us) AS duration_max FROM r GROUP BY ALL)"


@query(
    "ref_a14_hourly",
    f"WITH {_HOUR}, q AS (SELECT strftime(make_timestamp(start_us), '%Y-%m-%d-%H') AS hour, service_id, fingerprint, duration_us FROM r QUALIFY row_number() OVER (PARTITION BY 1, service_id, fingerprint, start_us // 3600000000 ORDER BY md5(trace_id)) <= 200),"
    " sm AS (SELECT hour, service_id, fingerprint, list(duration_us ORDER BY duration_us) AS samples FROM q GROUP BY ALL) SELECT h.*, samples FROM h JOIN sm USING (hour, service_id, fingerprint)",
)
def a14(s, d):
    """Hourly buckets with their samples."""
    return rollup.hourly(written(traces(s, d), "traces"))


@query("ref_a15_top_shares", f"WITH {R}, n AS (SELECT service_id, fingerprint, count(*) AS n FROM r GROUP BY ALL) SELECT service_id, fingerprint, round(n / (sum(n) OVER (PARTITION BY service_id))::DOUBLE, 9) AS share, CAST(row_number() OVER (PARTITION BY service_id ORDER BY n DESC, fingerprint) AS INT) AS rank FROM n QUALIFY rank <= 3")
def a15(s, d):
    return graph.top_shares(traces(s, d)).withColumn("share", F.round("share", 9))


# --- joins, sorting, sets ------------------------------------------------------------------------


@query(
    "ref_j4_same_hour_before",
    f"""WITH {_HOUR}, b AS (SELECT hour, service_id, CAST(sum(n) AS BIGINT) AS total FROM h GROUP BY ALL),
    q AS (SELECT trace_id, service_id, fingerprint, start_us - 86400000000 * (1 + CASE dayofweek(make_timestamp(start_us - 86400000000)) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END) AS base FROM r),
    c AS (SELECT trace_id, q.service_id, fingerprint, strftime(make_timestamp(base + o * 3600000000), '%Y-%m-%d-%H') AS hour FROM q, (SELECT unnest([-2, -1, 0, 1, 2]) AS o)),
    j AS (SELECT c.*, b.total FROM c JOIN b USING (hour, service_id) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY b.total DESC, hour) = 1)
    SELECT j.trace_id, j.hour, j.total, coalesce(h.n, 0) AS path_n FROM j LEFT JOIN h ON h.hour = j.hour AND h.service_id = j.service_id AND h.fingerprint = j.fingerprint""",
)
def j4(s, d):
    """The busiest of the five comparison hours of every trace, and how often it saw the trace's path."""
    t = written(traces(s, d), "traces")
    h = written(rollup.hourly(t).select("hour", "service_id", "fingerprint", "n"), "hourly")
    b = h.groupBy("hour", "service_id").agg(F.sum("n").alias("total"))
    c = t.select("trace_id", "service_id", "fingerprint", F.explode(rollup.comparison_hours(F.col("start_us"))).alias("hour")).join(b, ["hour", "service_id"])
    best = c.withColumn("_n", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("total"), "hour"))).filter("_n = 1").drop("_n")
    return best.join(h, ["hour", "service_id", "fingerprint"], "left").select("trace_id", "hour", "total", F.coalesce("n", F.lit(0)).alias("path_n"))


@query("ref_j5_not_important", f"WITH {_LAST}, {FI} SELECT trace_id FROM cr WHERE trace_id NOT IN (SELECT trace_id FROM f)")
def j5(s, d):
    t = counting_rows(table(s, d, "traces")).select(trace_hex(F.col("th"), F.col("tl")).alias("trace_id"))
    return t.join(findings(s, d).select("trace_id"), "trace_id", "left_anti")


_SAVED = "SELECT DISTINCT service_id, variant AS combination FROM f"


@query(
    "ref_j6_fallback",
    f"WITH {FI}, sv AS ({_SAVED}) SELECT service_id, combination FROM (SELECT *, CASE WHEN combination = 'cumulative:5000' THEN 0 WHEN starts_with(combination, 'cumulative:') THEN 1 WHEN coalesce(combination, '') = '' THEN 2 END AS q,"
    " row_number() OVER (PARTITION BY service_id ORDER BY CASE WHEN combination = 'cumulative:5000' THEN 0 WHEN starts_with(combination, 'cumulative:') THEN 1 WHEN coalesce(combination, '') = '' THEN 2 END NULLS LAST, TRY_CAST(string_split(combination, ':')[2] AS BIGINT)) AS k FROM sv) WHERE k = 1 AND q IS NOT NULL",
)
def j6(s, d):
    """The snapshot that a combination starts from, where each service has saved some (here those that it has findings of)."""
    saved = findings(s, d).select("service_id", F.col("variant").alias("combination")).distinct()
    return snapshots.fallback(saved, "cumulative:5000")


@query("ref_x1_recent_traces", f"WITH {R} SELECT trace_id, start_us FROM r ORDER BY start_us DESC, trace_id LIMIT 50")
def x1(s, d):
    return traces(s, d).select("trace_id", "start_us").orderBy(F.desc("start_us"), "trace_id").limit(50)


@query("ref_x1_recent_findings", f"WITH {FI} SELECT kind, id FROM f ORDER BY created_at DESC, kind, id LIMIT 100")
def x1b(s, d):
    return findings(s, d).orderBy(F.desc("created_at"), "kind", "id").limit(100).select("kind", "id")


@query("ref_x2_one_trace", f"WITH {K} SELECT trace_id, span_id, dur AS duration_us, {STATUS} AS status FROM k WHERE trace_id = (SELECT max(trace_id) FROM k)")
def x2(s, d):
    """Spans of one trace (the one with the greatest id) by a point read of the laid out spans."""
    from spanloom.plans.api import Engine

    top = spans(s, d).agg(F.max("trace_id")).collect()[0][0]
    return Engine(s, d).trace(top).select("trace_id", "span_id", "duration_us", "status")


@query("ref_x5_pending_ids", "SELECT DISTINCT trace_id FROM pending_traces")
def x5(s, d):
    return table(s, d, "pending_traces").select("trace_id").distinct()


@query(
    "ref_u1_memory_wins",
    f"WITH {SPANS_SQL}, m AS (SELECT *, CASE WHEN batch_id % 4 = 0 THEN 1 ELSE 0 END AS here FROM (SELECT {_id('trace_id', 32)} AS t, {_id('span_id', 16)} AS s, arrival, duration, batch_id FROM spans WHERE trim(coalesce(trace_id, '')) <> '' AND trim(coalesce(span_id, '')) <> ''))"
    " SELECT t AS trace_id, s AS span_id, duration, here = 1 AS in_memory FROM m QUALIFY row_number() OVER (PARTITION BY t, s ORDER BY here DESC, arrival DESC, duration) = 1",
)
def u1(s, d):
    """Spans of a trace on disk and in memory (here every fourth delivery batch): what is in memory wins, else the latest copy."""
    raw = _raw(s, d)
    memory = F.coalesce(F.pmod("batch_id", F.lit(4)) == 0, F.lit(False))
    x = assembly.latest_copies(assembly.with_memory(raw.filter(~memory), raw.filter(memory)))
    return x.select("trace_id", "span_id", "duration", (F.col("arrival") >= F.lit(1 << 62)).alias("in_memory"))


@query("ref_u2_pending_not_stored", "SELECT trace_id FROM pending_traces EXCEPT SELECT trace_id FROM traces")
def u2(s, d):
    return table(s, d, "pending_traces").select("trace_id").subtract(table(s, d, "traces").select("trace_id"))
