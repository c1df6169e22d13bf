"""Fifteen-minute rollups, hourly buckets, merging and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.percentile import nearest_low_sorted
from spanloom.functions.spans import status

WINDOW_US = 15 * 60_000_000
SAMPLES, HOUR_SAMPLES, SAMPLE_IDS = 1000, 200, 10


def sampled(value: str, order: Column, limit: int, key: list[str], df: DataFrame) -> DataFrame:
    """The first ``limit`` rows per ``key`` by a hash order: a sample that any run and any partitioning repeats. Whole groups up to the limit."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order, value))).filter(F.col("_r") <= limit).drop("_r")


def numbered(df: DataFrame, key: list[str], order: list[str], at: str, width: int = 3_600_000_000) -> DataFrame:
    """``df`` with ``seq`` (place of the row within ``key`` by ``order``, from 1) and ``n_all`` (rows of the key), without a task that holds a whole key.

    ``order`` begins with ``at``, whole numbers that are cut into ranges of ``width``: rows are numbered within key and range, and the few counts of the ranges
    before are added. A range is a task's share of a busy key."""
    from pyspark.sql import Window

    r = df.withColumn("_range", F.floor(F.col(at) / F.lit(width)))
    counts = r.groupBy(*key, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key)
    sums = counts.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_range").alias("_k_range"), (F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("n_all"))
    on = F.col("_range").eqNullSafe(F.col("_k_range"))
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    seq = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*order)).cast("bigint")
    return r.withColumn("_seq", seq).join(sums, on).withColumn("seq", F.col("_seq") + F.col("_before")).drop("_seq", "_before", "_range", "_k_range", *[f"_k_{k}" for k in key])


def rollups(traces: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Per window, service and fingerprint: counts, sums, extremes, p50 and p99 of at most 1000 samples, the first ten trace ids.

    ``traces`` has ``trace_id, service_id, fingerprint, start_us, span_count, duration_us, has_error``. Groups of more than 1000 traces
    are sampled by a hash of the trace id."""
    key = ["window_start", "service_id", "fingerprint"]
    t = traces.withColumn("window_start", F.col("start_us") - F.pmod("start_us", F.lit(window_us)))
    main = t.groupBy(*key).agg(
        F.count("*").alias("trace_count"), F.sum("span_count").alias("span_count"), F.count_if("has_error").alias("error_count"),
        F.sum("duration_us").alias("duration_sum"), F.min("duration_us").alias("duration_min"), F.max("duration_us").alias("duration_max"),
    )
    few = sampled("trace_id", F.md5("trace_id"), SAMPLES, key, t).groupBy(*key).agg(F.sort_array(F.collect_list("duration_us")).alias("s"))
    ids = sampled("trace_id", F.col("start_us"), SAMPLE_IDS, key, t).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start_us", "trace_id"))).alias("i"))
    return main.join(few, key).join(ids, key).select(
        *main.columns, nearest_low_sorted(F.col("s"), 0.5).alias("p50"), nearest_low_sorted(F.col("s"), 0.99).alias("p99"), F.col("i.trace_id").alias("sample_trace_ids")
    )


def branch_stats(spans: DataFrame, traces: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Per window, service and fingerprint: a map from ``service:operation`` to count, sum, min, max and errors of its spans."""
    t = traces.select("trace_id", "service_id", "fingerprint", (F.col("start_us") - F.pmod("start_us", F.lit(window_us))).alias("window_start"))
    s = spans.select("trace_id", F.concat_ws(":", "service_name", "operation_name").alias("branch"), "duration", (status(F.col("tags")) == "ERROR").alias("bad"))
    key = ["window_start", "service_id", "fingerprint"]
    return s.join(t, "trace_id").groupBy(*key, "branch").agg(
        F.count("*").alias("n"), F.sum("duration").alias("duration_sum"), F.min("duration").alias("duration_min"), F.max("duration").alias("duration_max"), F.count_if("bad").alias("error_count")
    )


def as_map(stats: DataFrame) -> DataFrame:
    """``branch_stats`` rows gathered into one map per rollup (as many entries as the path has branches)."""
    entry = F.struct("branch", F.struct("n", "duration_sum", "duration_min", "duration_max", "error_count").alias("stats"))
    return stats.groupBy("window_start", "service_id", "fingerprint").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("branch_stats"))


def merge_branches(parts: DataFrame) -> DataFrame:
    """Partial ``branch_stats`` of the same rollup and branch into one."""
    return parts.groupBy("window_start", "service_id", "fingerprint", "branch").agg(
        F.sum("n").alias("n"), F.sum("duration_sum").alias("duration_sum"), F.min("duration_min").alias("duration_min"), F.max("duration_max").alias("duration_max"), F.sum("error_count").alias("error_count")
    )


def merge(parts: DataFrame, order: str) -> DataFrame:
    """Partial rollups of one window, service and path into one (as many as the flushes of its window): counts and sums add up, percentiles become the count-weighted whole-number mean, taken in steps in
    the order of ``order`` as they arrive, and the first ten distinct sample ids stay."""
    key = ["window_start", "service_id", "fingerprint"]
    seq = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("trace_count").cast("bigint").alias("n"), F.col("p50").cast("bigint").alias("p50"), F.col("p99").cast("bigint").alias("p99"), F.col("sample_trace_ids").alias("ids"))))
    g = parts.groupBy(*key).agg(
        F.sum("trace_count").alias("trace_count"), F.sum("span_count").alias("span_count"), F.sum("error_count").alias("error_count"), F.sum("duration_sum").alias("duration_sum"),
        F.min("duration_min").alias("duration_min"), F.max("duration_max").alias("duration_max"), seq.alias("seq"),
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("p50"), F.lit(0).cast("bigint").alias("p99"))
    mean = lambda a, x, f: F.floor((a[f] * a["n"] + x[f] * x["n"]) / F.nullif(a["n"] + x["n"], F.lit(0))).cast("bigint")
    fold = F.aggregate("seq", zero, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.coalesce(mean(a, x, "p50"), F.lit(0).cast("bigint")).alias("p50"), F.coalesce(mean(a, x, "p99"), F.lit(0).cast("bigint")).alias("p99")))
    return g.withColumn("f", fold).select(*[c for c in g.columns if c != "seq"], "f.p50", "f.p99", F.slice(F.array_distinct(F.flatten("seq.ids")), 1, SAMPLE_IDS).alias("sample_trace_ids"))


def hourly(traces: DataFrame) -> DataFrame:
    """Per UTC hour, service and fingerprint: ``n, duration_sum, duration_min, duration_max, samples`` (at most 200, by hash order)."""
    key = ["hour", "service_id", "fingerprint"]
    t = traces.withColumn("hour", F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd-HH"))
    main = t.groupBy(*key).agg(F.count("*").alias("n"), F.sum("duration_us").alias("duration_sum"), F.min("duration_us").alias("duration_min"), F.max("duration_us").alias("duration_max"))
    few = sampled("trace_id", F.md5("trace_id"), HOUR_SAMPLES, key, t).groupBy(*key).agg(F.sort_array(F.collect_list("duration_us")).alias("samples"))
    return main.join(few, key)


def comparison_hours(start_us: Column) -> Column:
    """The five hour keys that a trace compares to: the same hour of the day before, two hours around; weekends and Mondays look at Friday."""
    day = F.timestamp_micros(start_us - F.lit(86_400_000_000))
    back = F.when(F.dayofweek(day) == 7, 1).when(F.dayofweek(day) == 1, 2).otherwise(0)
    base = start_us - F.lit(86_400_000_000) * (F.lit(1) + back)
    return F.transform(F.array(*[F.lit(i) for i in range(-2, 3)]), lambda i: F.date_format(F.timestamp_micros(base + i * F.lit(3_600_000_000)), "yyyy-MM-dd-HH"))


def tier_of(rollups: DataFrame, now_us: int, warm_minutes: int = 60) -> DataFrame:
    """``rollups`` with ``tier``: ``cold`` once their window ended ``warm_minutes`` ago or more, else ``warm``."""
    end = F.col("window_start") + F.lit(WINDOW_US)
    return rollups.withColumn("tier", F.when(end < F.lit(now_us - warm_minutes * 60_000_000), "cold").otherwise("warm"))


def tiers(traces: DataFrame, important: DataFrame, now_us: int, hot_minutes: int = 15, factor: int = 10) -> DataFrame:
    """Traces still hot at ``now_us``: younger than ``hot_minutes``, or ``factor`` times that if they are in ``important`` (``trace_id``)."""
    age = F.lit(now_us) - F.col("start_us")
    kept = traces.filter(age < F.lit(hot_minutes * factor * 60_000_000))
    young = age < F.lit(hot_minutes * 60_000_000)
    return kept.filter(young).unionByName(kept.filter(~young).join(important.select("trace_id").distinct(), "trace_id", "left_semi"))
