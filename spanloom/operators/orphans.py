"""References to records that do not exist.

A left anti-join of the distinct non-null foreign keys against the parent keys finds the dangling
keys; joined back to the referring rows they give every orphan and the counts per table and period.
Only fixed-width keys are shuffled. Keys are made distinct before (map-side combined) and after the
shuffle, so a parent that a third of all rows name costs one row per task; in the join back such a
key is on the streamed side of a semi-join, which AQE splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.event_time import PERIOD_US, period_start
from spanloom.functions.ids import span_hex, trace_bits, trace_hex
from spanloom.sources.tables import usable_spans, valid_edges
from spanloom.workdir import written


def dangling_keys(refs: DataFrame, ref_cols: list[str], parents: DataFrame, key_cols: list[str]) -> DataFrame:
    """The distinct keys in ``ref_cols`` of ``refs``, none of them null, that no row of ``parents`` has in ``key_cols``.

    Extra columns and clashing names on either side play no part. Null keys refer to nothing."""
    names = [f"k{i}" for i in range(len(ref_cols))]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ref_cols])
    keys = refs.filter(known).select(*[F.col(c).alias(n) for c, n in zip(ref_cols, names)]).distinct()
    have = parents.select(*[F.col(c).alias(n) for c, n in zip(key_cols, names)])
    return keys.join(have, names, "left_anti")


def orphan_rows(refs: DataFrame, ref_cols: list[str], parents: DataFrame, key_cols: list[str]) -> DataFrame:
    """The rows of ``refs`` whose key dangles, repeated rows included, with all their columns."""
    keys = dangling_keys(refs, ref_cols, parents, key_cols)
    on = reduce(lambda a, b: a & b, [refs[c] == keys[f"k{i}"] for i, c in enumerate(ref_cols)])
    return refs.join(keys, on, "left_semi")


#: Tables that refer to traces, with the instant that puts a row into a period.
TRACE_REFS = {"traces": "created_at", "pending_traces": "first_seen", "anomalies": "created_at", "deviations": "created_at"}


def trace_refs(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows ``src, th, tl, period_us`` of all tables that refer to traces; rows without a trace id refer to nothing."""
    out = []
    for src, at in TRACE_REFS.items():
        th, tl = trace_bits(F.col("trace_id"))
        us = F.unix_micros(F.col(at).cast("timestamp"))
        out.append(tables[src].select(F.lit(src).alias("src"), th.alias("th"), tl.alias("tl"), period_start(us).alias("period_us")))
    return reduce(DataFrame.unionByName, out).filter("th is not null")


def find_orphans(spans: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Every dangling reference: ``src, trace_id, span_id``.

    ``src`` is ``'spans'`` for a span whose valid copy names a parent that no usable row of its trace has, else the
    table whose ``trace_id`` (once per table, ``span_id`` empty) has no usable row in ``spans``. Empty tables give
    no rows; null keys are no references."""
    edges = written(valid_edges(usable_spans(spans)).select("th", "tl", "s", "p"), "edges")
    lost_spans = orphan_rows(edges, ["th", "tl", "p"], edges, ["th", "tl", "s"])
    refs = written(trace_refs(tables).select("src", "th", "tl").distinct(), "trace-refs")
    # one row per trace is enough to know that it exists
    lost_traces = orphan_rows(refs, ["th", "tl"], edges.select("th", "tl").distinct(), ["th", "tl"])
    trace = trace_hex(F.col("th"), F.col("tl")).alias("trace_id")
    return lost_spans.select(F.lit("spans").alias("src"), trace, span_hex(F.col("s")).alias("span_id")).unionByName(
        lost_traces.select("src", trace, F.lit("").alias("span_id"))
    )


def orphan_counts(spans: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and 15-minute period: ``src, period_us, n_refs, n_dangling`` over all referring rows.

    Spans count once each, by the valid copy and its event time. ``period_us`` is null where the row has no instant."""
    edges = written(valid_edges(usable_spans(spans)), "edges")
    children = edges.filter("p is not null").select(
        F.lit("spans").alias("src"), "th", "tl", "p", period_start(F.col("event_us"), PERIOD_US).alias("period_us")
    )
    # counts per key and period first: what is joined back is as small as it can be
    per_key = children.groupBy("src", "th", "tl", "p", "period_us").agg(F.count("*").alias("n"))
    lost = dangling_keys(children, ["th", "tl", "p"], edges, ["th", "tl", "s"]).withColumn("lost", F.lit(1))
    on = (per_key.th == lost.k0) & (per_key.tl == lost.k1) & (per_key.p == lost.k2)
    a = per_key.join(lost, on, "left").select("src", "period_us", "n", "lost")
    per_trace = trace_refs(tables).groupBy("src", "th", "tl", "period_us").agg(F.count("*").alias("n"))
    gone = dangling_keys(per_trace, ["th", "tl"], edges, ["th", "tl"]).withColumn("lost", F.lit(1))
    b = per_trace.join(gone, (per_trace.th == gone.k0) & (per_trace.tl == gone.k1), "left").select("src", "period_us", "n", "lost")
    return (
        a.unionByName(b)
        .groupBy("src", "period_us")
        .agg(F.sum("n").alias("n_refs"), F.coalesce(F.sum(F.when(F.col("lost") == 1, F.col("n"))), F.lit(0)).alias("n_dangling"))
    )
