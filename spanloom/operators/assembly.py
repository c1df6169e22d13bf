"""Spans to traces: cleaning, one copy each, assembly, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import span_hex, trace_hex
from spanloom.functions.spans import dimensions, join_identity, lookup, signature, status
from spanloom.operators.config import DIMENSIONS, OPERATION_KEYS, SERVICE_NAME_KEYS, Config
from spanloom.sources.tables import usable_spans

NO_TAGS = "cast(map() as map<string,string>)"


def latest_copies(spans: DataFrame) -> DataFrame:
    """One row per span by its latest arrival, with canonical ids and '' for null names and parents.

    Columns ``trace_id, span_id, parent_id, operation_name, start_time, duration, tags, service_name, arrival``; ``start_time`` is
    the event time in microseconds, null where there is none."""
    u = usable_spans(spans, "operation_name", "duration", "tags", "service_name")
    rest = F.struct("p", "event_us", "operation_name", "duration", "tags", "service_name", "arrival")
    at = F.coalesce(F.col("arrival"), F.lit(-(2**63)))
    v = u.groupBy("th", "tl", "s").agg(F.max_by(rest, at).alias("r"))
    return v.select(
        trace_hex(F.col("th"), F.col("tl")).alias("trace_id"),
        span_hex(F.col("s")).alias("span_id"),
        F.coalesce(span_hex(F.col("r.p")), F.lit("")).alias("parent_id"),
        F.coalesce("r.operation_name", F.lit("")).alias("operation_name"),
        F.col("r.event_us").alias("start_time"),
        "r.duration",
        F.coalesce("r.tags", F.expr(NO_TAGS)).alias("tags"),
        F.coalesce("r.service_name", F.lit("")).alias("service_name"),
        "r.arrival",
    )


def with_memory(stored: DataFrame, memory: DataFrame) -> DataFrame:
    """Raw spans on disk and in memory as one table, where those in memory win: for ``latest_copies`` they arrive after all that is stored.

    Both have the columns of raw spans. A stored copy of a span that is in memory too is left behind by the later arrival."""
    late = F.lit(1 << 62)
    here = memory.withColumn("arrival", F.greatest(F.coalesce("arrival", F.lit(0)), F.lit(0)) + late)
    return stored.unionByName(here)


def valid_spans(spans: DataFrame) -> DataFrame:
    """Latest copies with an event time and a duration of zero or more."""
    return latest_copies(spans).filter("start_time is not null and duration >= 0")


ORDER = ("start_time", "span_id")


def assemble(spans: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per trace of ``valid_spans``.

    The root is the first span without parent, else the earliest (ties by span id). A grouping value is the root's own, else the first
    other span's that has one. ``service_id`` joins the identity fields. ``end_us`` is at least 0; ``duration_us`` is end minus start."""
    tags, is_child = F.col("tags"), F.col("parent_id") != ""
    keys = {d: config.keys(d) for d in DIMENSIONS[:-1]} | {"operation": OPERATION_KEYS, "_service_name": SERVICE_NAME_KEYS}
    extra = [f for f in config.identity_fields if f not in (*DIMENSIONS, "service_name", "operation_name")]
    # all that the root gives is taken together, in one comparison a span
    root = F.min_by(F.struct("span_id", "service_name", "operation_name", "tags"), F.struct(is_child, *ORDER))

    def other(d: str, ks: list[str]) -> Column:
        v = lookup(tags, ks)
        return F.min_by(F.when(v != "", v), F.when(v != "", F.struct(*ORDER))).alias(f"o_{d}")

    g = spans.groupBy("trace_id").agg(
        F.count("*").alias("span_count"),
        F.min("start_time").alias("start_us"),
        F.greatest(F.max(F.col("start_time") + F.col("duration")), F.lit(0)).alias("end_us"),
        F.bool_or(status(tags) == "ERROR").alias("has_error"),
        root.alias("_root"),
        *[other(d, ks) for d, ks in keys.items()],
    )
    its = F.col("_root.tags")
    g = g.select(
        *[c for c in g.columns if c != "_root"], F.col("_root.span_id").alias("root_span_id"), F.col("_root.service_name").alias("root_service"), F.col("_root.operation_name").alias("root_operation"),
        *[lookup(its, ks).alias(f"r_{d}") for d, ks in keys.items()], *[F.coalesce(its[f], F.lit("")).alias(f"x_{i}") for i, f in enumerate(extra)],
    )
    some = lambda d: F.coalesce(F.nullif(f"r_{d}", F.lit("")), F.col(f"o_{d}"), F.lit(""))
    dims = {d: some(d) for d in DIMENSIONS[:-1]}
    dims["service_identity"] = F.coalesce(F.nullif(dims["service_identity"], F.lit("")), "root_service")
    dims["operation"] = F.coalesce(F.nullif("root_operation", F.lit("")), some("operation"))
    values = {d: F.col(d) for d in DIMENSIONS} | {"service_name": F.coalesce(F.nullif(some("_service_name"), F.lit("")), "root_service"), "operation_name": F.col("root_operation")}
    values |= {f: F.col(f"x_{i}") for i, f in enumerate(extra)}
    return (
        g.withColumns(dims)
        .withColumn("service_id", join_identity([values[f] for f in config.identity_fields], F.concat_ws(":", "root_service", "root_operation")))
        .select("trace_id", "service_id", *DIMENSIONS, "root_span_id", "span_count", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "has_error")
    )


def with_signature(spans: DataFrame, config: Config = Config()) -> DataFrame:
    return spans.withColumn("signature", signature(F.col("tags"), F.col("service_name"), F.col("operation_name"), config))


def grouping_columns(config: Config = Config()) -> list[Column]:
    """The nine own grouping values of a span."""
    return [c.alias(d) for d, c in dimensions(F.col("tags"), F.col("service_name"), F.col("operation_name"), config).items()]


def edges(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, branch_key, duration_us, is_error`` of each span whose parent is in its trace; a shuffle join on both ids."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.concat_ws(":", "service_name", "operation_name").alias("_from"))
    c = spans.filter("parent_id <> ''")
    return c.join(p, ["trace_id", "parent_id"]).select(
        "trace_id", "span_id", F.concat("_from", F.lit("->"), F.concat_ws(":", "service_name", "operation_name")).alias("branch_key"), F.col("duration").alias("duration_us"), (status(F.col("tags")) == "ERROR").alias("is_error")
    )
