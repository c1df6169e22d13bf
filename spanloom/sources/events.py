"""Sources of spans: event streams, JSON batches, trace-export JSON, Parquet exports; their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "TraceID string, SpanID string, ParentID string, OperationName string, StartTime bigint, Duration bigint, Tags map<string,string>, ServiceName string"
# Columns of an export that become tags, and those that name the grouping.
TAG_COLUMNS = ["http.method", "http.url", "http.status_code", "http.route", "db.system", "db.statement", "rpc.system", "rpc.method", "error", "otel.status_code", "otel.status_description"]
IDENTITY_COLUMNS = ["service_identity", "scope1", "scope2", "scope3", "env", "feature_group", "feature_name", "sub_service"]
# Spans of a request, and bytes of one with many spans and of one with a single span.
BATCH_LIMIT, BODY_LIMIT, SPAN_BODY_LIMIT = 1000, 10 << 20, 1 << 20


def sse_events(text: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Events of an event stream: ``event, data``. One row of ``text`` holds whole events, separated by empty lines.

    Several ``data:`` lines of one event are put together without a separator; an event without data is none. The last ``event:`` line counts."""
    event = F.explode(F.split(F.regexp_replace(F.col(column), "\r\n", "\n"), "\n\n+")).alias("_e")
    lines = F.split("_e", "\n")
    trimmed = lambda prefix: F.transform(F.filter(lines, lambda x: x.startswith(prefix)), lambda x: F.trim(F.substring(x, len(prefix) + 1, 1 << 30)))
    return text.select(*keep, event).select(*keep, F.coalesce(F.try_element_at(trimmed("event:"), F.lit(-1)), F.lit("")).alias("event"), F.array_join(trimmed("data:"), "").alias("data")).filter("data <> ''")


def span_batches(events: DataFrame, *keep: str) -> DataFrame:
    """Spans of the events that carry them (``trace_batch`` or no type); other types are skipped."""
    return parse_batches(events.filter(F.col("event").isin("trace_batch", "")), "data", *keep)


def parse_batches(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Each text as a JSON array of spans, else as one span: the spans' columns and ``bad``. A text that is neither gives one row with ``bad`` set."""
    as_many = F.from_json(F.col(column), f"array<struct<{SPAN.replace(' string', ':string').replace(' bigint', ':bigint').replace(' map<', ':map<')}>>")
    as_one = F.from_json(F.col(column), SPAN)
    is_array = F.ltrim(F.col(column)).startswith("[")
    one = F.when(F.ltrim(F.col(column)).startswith("{") & F.get_json_object(column, "$").isNotNull(), F.array(as_one))
    rows = df.select(*keep, F.explode_outer(F.when(is_array, as_many).otherwise(one)).alias("s"))
    return rows.select(*keep, "s.*", F.col("s").isNull().alias("bad"))


def accepted(df: DataFrame, trace: str = "TraceID", span: str = "SpanID") -> Column:
    """Whether a span may come in: neither id null nor empty."""
    return (F.coalesce(F.col(trace), F.lit("")) != "") & (F.coalesce(F.col(span), F.lit("")) != "")


def batch_report(df: DataFrame, batch: str, trace: str, span: str) -> DataFrame:
    """Per batch: ``accepted, rejected``."""
    ok = accepted(df, trace, span)
    return df.groupBy(batch).agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def ingest(requests: DataFrame, request: str, body: str) -> tuple[DataFrame, DataFrame]:
    """Requests whose ``body`` is JSON, one span or an array: the spans that come in, and per request ``accepted, rejected, error``.

    Spans without an id are rejected one by one. A body that is no JSON of spans, or holds more than ``BATCH_LIMIT`` spans or ``BODY_LIMIT`` bytes, is
    refused whole. An empty array is accepted."""
    is_array = F.ltrim(F.col(body)).startswith("[")
    n = F.when(is_array, F.coalesce(F.json_array_length(body), F.lit(-1))).otherwise(F.when(F.ltrim(F.col(body)).startswith("{") & F.get_json_object(body, "$").isNotNull(), 1).otherwise(-1))
    error = (
        F.when(F.octet_length(body) > F.when(is_array, BODY_LIMIT).otherwise(SPAN_BODY_LIMIT), "request body too large")
        .when(F.coalesce(n, F.lit(-1)) < 0, "invalid body")
        .when(n > BATCH_LIMIT, f"batch size exceeds maximum of {BATCH_LIMIT} spans")
    )
    judged = requests.select(F.col(request), F.col(body), error.alias("error"))
    spans = parse_batches(judged.filter("error is null"), body, request)
    ok = accepted(spans)
    counted = spans.groupBy(request).agg(F.count_if(ok).alias("accepted"), F.count_if(~ok & ~F.col("bad")).alias("rejected"))
    report = judged.select(request, "error").join(counted, request, "left").select(request, F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("rejected", F.lit(0)).alias("rejected"), "error")
    return spans.filter(ok).drop("bad"), report


def from_export(df: DataFrame) -> DataFrame:
    """Rows of a Parquet export (``trace_id, span_id, parent_id, name, timestamp_micros, duration_micros, local_endpoint_service_name``,
    optional tag columns with dots or underscores, identity columns, ``attributes`` map) as spans.

    Rows without ids, with a start that is not a number above 0 or a duration below 0 are left out. Attributes override columns."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    text = lambda c: F.col(f"`{c}`").cast("string")
    entries: list[Column] = []
    for t in TAG_COLUMNS:
        names = [n for n in (t, t.replace(".", "_")) if n in have]
        if names:
            entries.append(F.struct(F.lit(t).alias("key"), F.coalesce(*[text(n) for n in names]).alias("value")))
    entries += [F.struct(F.lit(t).alias("key"), F.nullif(text(t), F.lit("")).alias("value")) for t in IDENTITY_COLUMNS if t in have]
    tags = F.array(*entries) if entries else F.expr("cast(array() as array<struct<key:string,value:string>>)")
    if have.get("attributes", "").startswith("map<"):
        more = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].cast("string").alias("value")))
        more = F.filter(F.coalesce(more, F.expr("cast(array() as array<struct<key:string,value:string>>)")), lambda e: e["value"].isNotNull())
        keys = F.transform(more, lambda e: e["key"])
        tags = F.concat(F.filter(tags, lambda e: ~F.array_contains(keys, e["key"])), more)
    tags = F.map_from_entries(F.filter(tags, lambda e: e["value"].isNotNull()))
    start, length = (F.expr(f"try_cast({c} as bigint)") if c in have else F.lit(None).cast("bigint") for c in ("timestamp_micros", "duration_micros"))
    opt = lambda c: F.coalesce(text(c), F.lit("")) if c in have else F.lit("")
    out = df.select(opt("trace_id").alias("trace_id"), opt("span_id").alias("span_id"), opt("parent_id").alias("parent_id"), opt("name").alias("operation_name"), start.alias("start_time"), length.alias("duration"), tags.alias("tags"), opt("local_endpoint_service_name").alias("service_name"))
    return out.filter("trace_id <> '' and span_id <> '' and start_time > 0 and duration >= 0")


_OTLP = (
    "resourceSpans array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>>,scopeSpans:array<struct<spans:array<struct<"
    "traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string>,"
    "attributes:array<struct<key:string,value:struct<stringValue:string>>>>>>>>>"
)


def from_otlp(df: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """Spans of trace-export JSON (resource spans, scope spans): nanoseconds become microseconds by whole division, status code 2 sets the tag
    ``error=true``. Of repeated (trace, span) the last one counts: the greatest ``order`` of the texts, if given, then the last place within a text."""
    j = F.from_json(F.col(column), _OTLP)
    rank = F.col(order) if order else F.lit(0)
    r = df.select(rank.alias("_o"), F.posexplode(j["resourceSpans"]).alias("_i", "r")).select("_o", "_i", "r.resource", F.posexplode("r.scopeSpans").alias("_j", "c"))
    r = r.select("_o", "_i", "_j", "resource", F.posexplode("c.spans").alias("_k", "s"))
    name = F.try_element_at(F.map_from_entries(F.transform("resource.attributes", lambda a: F.struct(a["key"].alias("key"), a["value"]["stringValue"].alias("value")))), F.lit("service.name"))
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    tags = F.coalesce(F.transform("s.attributes", lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], F.lit("")).alias("value"))), none)
    bad = F.coalesce(F.col("s.status.code").isin("2", "STATUS_CODE_ERROR"), F.lit(False))
    tags = F.map_from_entries(F.when(bad, F.concat(F.filter(tags, lambda e: e["key"] != "error"), F.array(F.struct(F.lit("error").alias("key"), F.lit("true").alias("value"))))).otherwise(tags))
    us = lambda c: F.expr(f"try_cast({c} as decimal(20,0)) div 1000")
    out = r.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.coalesce("s.parentSpanId", F.lit("")).alias("parent_id"), F.coalesce("s.name", F.lit("")).alias("operation_name"),
        us("s.startTimeUnixNano").alias("start_time"), F.expr("(try_cast(s.endTimeUnixNano as decimal(20,0)) - try_cast(s.startTimeUnixNano as decimal(20,0))) div 1000").alias("duration"), tags.alias("tags"), F.coalesce(name, F.lit("")).alias("service_name"),
        F.struct("_o", "_i", "_j", "_k").alias("_at"),
    )
    cols = [c for c in out.columns if c not in ("trace_id", "span_id", "_at")]
    last = out.groupBy("trace_id", "span_id").agg(F.max_by(F.struct(*cols), "_at").alias("r"))
    return last.select("trace_id", "span_id", "r.*")
