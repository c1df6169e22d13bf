"""Call graphs: nodes, links and topology counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import status


def call_nodes(spans: DataFrame) -> DataFrame:
    """Per trace and ``service:operation``: ``n, duration_sum, status, is_root``; OK if any span is; ``is_root`` is that of the first span.

    Spans without service or operation are no nodes."""
    named = spans.filter("service_name <> '' and operation_name <> ''").withColumn("node", F.concat_ws(":", "service_name", "operation_name"))
    return named.groupBy("trace_id", "node").agg(
        F.count("*").alias("n"),
        F.sum("duration").alias("duration_sum"),
        F.when(F.bool_or(status(F.col("tags")) == "OK"), "OK").otherwise("ERROR").alias("status"),
        F.min_by(F.col("parent_id") == "", F.struct("start_time", "span_id")).alias("is_root"),
    )


def call_links(spans: DataFrame) -> DataFrame:
    """Per trace: ``source, target, n, first_duration`` between nodes, without links of a node to itself."""
    node = F.concat_ws(":", "service_name", "operation_name")
    named = spans.filter("service_name <> '' and operation_name <> ''")
    p = named.select("trace_id", F.col("span_id").alias("parent_id"), node.alias("source"))
    c = named.filter("parent_id <> ''").select("trace_id", "span_id", "parent_id", "start_time", "duration", node.alias("target"))
    return (
        c.join(p, ["trace_id", "parent_id"])
        .filter("source <> target")
        .groupBy("trace_id", "source", "target")
        .agg(F.count("*").alias("n"), F.min_by("duration", F.struct("start_time", "span_id")).alias("first_duration"))
    )


def topology_cardinality(spans: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Per root service and operation: traces, distinct mixes (multisets of names) and sizes, and shapes where ``shapes`` gives them. Traces with no root
    or several come out under a null root, counted alone."""
    name = F.concat_ws("|", "service_name", "operation_name")
    # equal names of a trace are counted first, so what is gathered is bounded by the different names
    names = spans.groupBy("trace_id", name.alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("parent_id") == "").alias("roots"))
    entry = F.concat_ws(" ", F.col("name"), F.col("n").cast("string"))
    per = names.groupBy("trace_id").agg(F.sum("roots").alias("roots"), F.max(F.when(F.col("roots") > 0, F.col("name"))).alias("root"), F.sum("n").alias("size"), F.md5(F.array_join(F.array_sort(F.collect_list(entry)), "\n")).alias("mix"))
    one = F.col("roots") == 1
    root = F.when(one, F.col("root")).alias("root")
    if shapes is not None:
        per = per.join(shapes.select("trace_id", "shape"), "trace_id")
    only = lambda c: F.countDistinct(F.when(one, F.col(c)))
    return per.groupBy(root).agg(F.count("*").alias("traces"), only("mix").alias("mixes"), only("size").alias("sizes"), *([only("shape").alias("shapes")] if shapes is not None else []))


def top_shares(traces: DataFrame, k: int = 3) -> DataFrame:
    """``service_id, fingerprint, share, rank``: the shares of a service's ``k`` most frequent fingerprints."""
    n = traces.groupBy("service_id", "fingerprint").agg(F.count("*").alias("n"))
    total = Window.partitionBy("service_id")
    ranked = n.select("*", (F.col("n") / F.sum("n").over(total)).alias("share"), F.row_number().over(total.orderBy(F.desc("n"), "fingerprint")).alias("rank"))
    return ranked.filter(F.col("rank") <= k).select("service_id", "fingerprint", "share", "rank")
