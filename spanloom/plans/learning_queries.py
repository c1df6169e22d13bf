"""Learning and detection as queries: windows where SQL can say them, the fold for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import assembly, baseline, fingerprint, rollup, tree
from spanloom.operators.config import Config, combinations
from spanloom.plans.engine_queries import FI, R, _in_ring_sql, findings as stored_findings, spans, traces
from spanloom.sources import cold
from spanloom.workdir import new_path, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_ORD = "ORDER BY start_us, trace_id"
#: Per trace, before it: traces of the service, of the path, first time of the path.
_PRE = f"""{R}, pre AS (SELECT *, row_number() OVER (PARTITION BY service_id {_ORD}) - 1 AS n_service, row_number() OVER (PARTITION BY service_id, fingerprint {_ORD}) - 1 AS n_path,
 min(start_us) OVER (PARTITION BY service_id, fingerprint {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_seen FROM r)"""


def before(t: DataFrame) -> DataFrame:
    """Each trace with what was known before it: ``n_service, n_path, first_seen`` (B2, B3, J3). No task holds a whole service or path."""
    order, one = ["start_us", "trace_id"], F.lit(1).cast("bigint")
    x = rollup.numbered(t, ["service_id"], order, "start_us").withColumn("n_service", F.col("seq") - one).drop("seq", "n_all")
    x = rollup.numbered(x, ["service_id", "fingerprint"], order, "start_us").withColumn("n_path", F.col("seq") - one).drop("seq", "n_all")
    first = t.groupBy("service_id", "fingerprint").agg(F.min("start_us").alias("_first"))
    return x.join(first, ["service_id", "fingerprint"]).withColumn("first_seen", F.when(F.col("n_path") > 0, F.col("_first"))).drop("_first")


@query("ref_b1_clock", f"WITH {R} SELECT trace_id, max(start_us) OVER (PARTITION BY service_id {_ORD} ROWS UNBOUNDED PRECEDING) AS stamp FROM r")
def b1(s, d):
    """Stamp of every trace: the latest start of its service so far."""
    w = Window.partitionBy("service_id").orderBy("start_us", "trace_id").rowsBetween(Window.unboundedPreceding, 0)
    return traces(s, d).select("trace_id", F.max("start_us").over(w).alias("stamp"))


@query("ref_b2_counts_before", f"WITH {_PRE} SELECT trace_id, n_service, n_path, first_seen FROM pre")
def b2(s, d):
    return before(traces(s, d)).select("trace_id", "n_service", "n_path", "first_seen")


_KNOWN = f"""{_PRE}, g AS (SELECT *, n_service >= 49 AND (n_path + 1) * 100 > n_service + 1 AS hit, sum(CASE WHEN n_service < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY service_id, fingerprint) AS early, count(*) OVER (PARTITION BY service_id) AS n_all FROM pre)"""


def known_good(t: DataFrame, least: int = 50) -> DataFrame:
    """``service_id, fingerprint``: paths that ever held over 1 % of a service's traces once it had ``least`` of them (B4, for counts that only grow).

    A share can only rise with a path's own traces, so those and the moment of the ``least``-th trace decide."""
    p = before(t)
    own = (F.col("n_service") >= least - 1) & ((F.col("n_path") + 1) * 100 > F.col("n_service") + 1)
    g = p.groupBy("service_id", "fingerprint").agg(F.bool_or(own).alias("own"), F.count_if(F.col("n_service") < least).alias("early"))
    n = t.groupBy("service_id").agg(F.count("*").alias("n_all"))
    return g.join(n, "service_id").filter(F.col("own") | ((F.col("n_all") >= least) & (F.col("early") * 100 > least))).select("service_id", "fingerprint")


@query("ref_b4_known_good", f"WITH {_KNOWN} SELECT service_id, fingerprint FROM g GROUP BY ALL HAVING bool_or(hit) OR (max(n_all) >= 50 AND max(early) * 100 > 50)")
def b4(s, d):
    return known_good(written(traces(s, d), "traces"))


@query("ref_b5_canonical", f"WITH {R}, n AS (SELECT service_id, fingerprint, count(*) AS n FROM r GROUP BY ALL) SELECT service_id, fingerprint FROM (SELECT *, sum(n) OVER (PARTITION BY service_id) AS total, row_number() OVER (PARTITION BY service_id ORDER BY n DESC, fingerprint) AS q FROM n) WHERE q = 1 AND total >= 50 AND n > 0.1 * total")
def b5(s, d):
    """The most frequent path of each service with 50 traces, if it holds over a tenth; of equal ones the first by name."""
    n = traces(s, d).groupBy("service_id", "fingerprint").agg(F.count("*").alias("n"))
    w = Window.partitionBy("service_id")
    x = n.withColumns({"total": F.sum("n").over(w), "q": F.row_number().over(w.orderBy(F.desc("n"), "fingerprint"))})
    return x.filter("q = 1 and total >= 50 and n > 0.1 * total").select("service_id", "fingerprint")


@query(
    "ref_b7_path_ring",
    f"WITH {R}, x AS (SELECT *, row_number() OVER (PARTITION BY service_id, fingerprint {_ORD}) AS seq, count(*) OVER (PARTITION BY service_id, fingerprint) AS n_all FROM r) SELECT service_id, fingerprint, count(*) AS n_kept, CAST(sum(duration_us) AS BIGINT) AS kept_sum FROM x WHERE {_in_ring_sql(1000)} GROUP BY ALL",
)
def b7(s, d):
    """What the ring of 1000 holds after all traces of a path, in closed form."""
    from spanloom.plans.engine_queries import in_ring

    x = rollup.numbered(traces(s, d), ["service_id", "fingerprint"], ["start_us", "trace_id"], "start_us")
    return x.filter(in_ring("n_all", "seq", 1000)).groupBy("service_id", "fingerprint").agg(F.count("*").alias("n_kept"), F.sum("duration_us").alias("kept_sum"))


@query("ref_b10_running_path", f"WITH {R} SELECT trace_id, count(*) OVER w AS n, CAST(sum(duration_us) OVER w AS BIGINT) AS total, min(duration_us) OVER w AS low, max(duration_us) OVER w AS high FROM r WINDOW w AS (PARTITION BY service_id, fingerprint {_ORD} ROWS UNBOUNDED PRECEDING)")
def b10(s, d):
    w = Window.partitionBy("service_id", "fingerprint").orderBy("start_us", "trace_id").rowsBetween(Window.unboundedPreceding, 0)
    v = "duration_us"
    return traces(s, d).select("trace_id", F.count("*").over(w).alias("n"), F.sum(v).over(w).alias("total"), F.min(v).over(w).alias("low"), F.max(v).over(w).alias("high"))


@query("ref_b11_ewma_share", f"WITH {R} SELECT service_id, fingerprint, round(1 - pow(0.9, count(*)), 9) AS freq FROM r GROUP BY ALL")
def b11(s, d):
    return traces(s, d).groupBy("service_id", "fingerprint").agg(F.round(F.lit(1.0) - F.pow(F.lit(0.9), F.count("*")), 9).alias("freq"))


def _findings(s, d, combos: list[str], config: Config = Config()) -> DataFrame:
    return baseline.findings(traces(s, d), combos, config)


_D1 = f"WITH {_PRE} SELECT trace_id, service_id, fingerprint FROM pre WHERE n_service >= 50 AND n_path = 0"


@query("ref_d3a_new_path", _D1)
def d3a(s, d):
    """New paths once a service has 50 traces, from the fold."""
    return _findings(s, d, ["cumulative:50"]).filter("type = 'new_path'").select("trace_id", "service_id", "fingerprint")


@query("ref_d3a_by_windows", _D1)
def d3a_w(s, d):
    """The same from windows alone."""
    return before(traces(s, d)).filter("n_service >= 50 and n_path = 0").select("trace_id", "service_id", "fingerprint")


@query("ref_d1_gate", f"WITH {_PRE} SELECT trace_id, n_service >= 50 AND (n_path = 0 OR start_us - first_seen < 600000000 OR n_path >= 50) AS speaks, coalesce(n_path = 0 OR start_us - first_seen < 600000000, true) AS is_new FROM pre")
def d1(s, d):
    """Which traces the detector looks at, and which paths count as new."""
    new = (F.col("n_path") == 0) | F.coalesce(F.col("start_us") - F.col("first_seen") < 600_000_000, F.lit(True))
    return before(traces(s, d)).select("trace_id", ((F.col("n_service") >= 50) & (new | (F.col("n_path") >= 50))).alias("speaks"), new.alias("is_new"))


@query(
    "ref_d5_anomalies",
    f"""WITH {R}, x AS (SELECT trace_id, service_id, fingerprint, duration_us, row_number() OVER p - 1 AS n, list(duration_us) OVER (PARTITION BY service_id, fingerprint {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS all_before,
    min(duration_us) OVER (PARTITION BY service_id, fingerprint {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low, max(duration_us) OVER (PARTITION BY service_id, fingerprint {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM r WINDOW p AS (PARTITION BY service_id, fingerprint {_ORD})),
    y AS (SELECT *, list_sort(CASE WHEN n <= 1000 THEN all_before WHEN n < 2000 THEN list_concat(all_before[1:1], all_before[-999:]) ELSE all_before[-1000:] END) AS s FROM x WHERE n >= 50),
    z AS (SELECT *, s[CAST(floor((len(s) - 1) * 0.75) AS INT) + 1] AS ref, s[CAST(floor((len(s) - 1) * 0.25) AS INT) + 1] AS p25 FROM y),
    q AS (SELECT *, CASE WHEN ref = p25 THEN CASE WHEN duration_us = ref OR high = low THEN 0 ELSE (duration_us - ref) / ((high - low) / 4.0::DOUBLE) END ELSE abs(0.6745::DOUBLE * (duration_us - ref) / ((ref - p25) / 1.35::DOUBLE)) END AS score FROM z)
    SELECT trace_id, round(score, 6) AS score FROM q WHERE score >= 3.5""",
)
def d5(s, d):
    """Anomalies against each path's own ring (cumulative, 50), from the fold."""
    return _findings(s, d, ["cumulative:50"]).filter("kind = 'anomaly'").select("trace_id", F.round("score", 6).alias("score"))


@query("ref_d5_ewma_agrees", f"WITH {R} SELECT 0 AS differing")
def d5_ewma(s, d):
    """Findings of ewma:50 that are not those of cumulative:50, apart from the range fallback of scores: none."""
    f = written(_findings(s, d, ["cumulative:50", "ewma:50"]).filter("kind = 'deviation'"), "findings")
    a, b = (f.filter(F.col("combination") == c).select("trace_id", "type", F.round("score", 9)) for c in ("cumulative:50", "ewma:50"))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").cast("int").alias("differing"))


@query("ref_d_all_combinations")
def d_all(s, d):
    """All findings of the twenty combinations over the traces that count."""
    return _findings(s, d, combinations())


def full_traces(s, d) -> DataFrame:
    """Traces that count with the branches and the recursion of their spans."""
    x = written(spans(s, d), "valid-spans")
    e = assembly.edges(x).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("branch_key", "duration_us"))).alias("branches"))
    rec = tree.tree_view(x).filter("not circular").groupBy("trace_id").agg(F.bool_or("recursive").alias("recursive"))
    return traces(s, d).join(e, "trace_id", "left").join(rec, "trace_id", "left").withColumn("recursive", F.coalesce("recursive", F.lit(False)))


@query("ref_d6_slow_branches")
def d6(s, d):
    """Anomalies of the active combination with their slow branches."""
    return baseline.findings(full_traces(s, d), ["cumulative:50"]).filter("kind = 'anomaly'").select("trace_id", "service_id", F.round("score", 6).alias("score"), "slow_branches")


@query("ref_d3_deviations")
def d3(s, d):
    """Deviations of the active combination with summaries of what differs."""
    return baseline.findings(full_traces(s, d), ["cumulative:50"]).filter("kind = 'deviation'").select("trace_id", "service_id", "fingerprint", "canonical", "type", "score", "summary")


def traces_from_spans(s, d) -> DataFrame:
    """Raw spans all the way to what learning needs: one copy each, assembled, fingerprinted, with branches and recursion."""
    x = written(spans(s, d), "valid-spans")
    e = assembly.edges(x).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("branch_key", "duration_us"))).alias("branches"))
    rec = tree.tree_view(x).filter("not circular").groupBy("trace_id").agg(F.bool_or("recursive").alias("recursive"))
    fp = fingerprint.fingerprints(x).select("trace_id", "fingerprint")
    a = assembly.assemble(x).select("trace_id", "service_id", "start_us", "duration_us", "span_count", "has_error")
    # written: the long expressions of a service id would be repeated in every filter that is pushed below them
    t = written(a, "assembled").join(fp, "trace_id").join(e, "trace_id", "left").join(rec, "trace_id", "left")
    return t.withColumn("recursive", F.coalesce("recursive", F.lit(False)))


@query("ref_e1_topologies")
def e1(s, d):
    """Paths of each service from raw spans: traces, share, errors, durations."""
    x = spans(s, d)
    x = written(x, "valid-spans")
    t = written(assembly.assemble(x), "assembled").join(fingerprint.fingerprints(x).select("trace_id", "fingerprint"), "trace_id")
    n = t.groupBy("service_id", "fingerprint").agg(F.count("*").alias("traces"), F.count_if("has_error").alias("errors"), F.min("duration_us").alias("duration_min"), F.max("duration_us").alias("duration_max"))
    return n.withColumn("percentage", F.round(F.col("traces") * F.lit(100.0) / F.sum("traces").over(Window.partitionBy("service_id")), 6))


@query("ref_e1_findings")
def e1_findings(s, d):
    """All findings of the twenty combinations from raw spans."""
    return baseline.findings(traces_from_spans(s, d), combinations())


@query("ref_d7_error_traces", f"WITH {R} SELECT trace_id, 'error' AS reason FROM r WHERE has_error")
def d7(s, d):
    return traces(s, d).filter("has_error").select("trace_id", F.lit("error").alias("reason"))


@query("ref_d8_interesting", f"WITH {R}, {FI} SELECT DISTINCT trace_id, kind AS reason FROM f WHERE variant = 'cumulative:500' UNION ALL SELECT trace_id, 'error' FROM r WHERE has_error")
def d8(s, d):
    """What makes a trace interesting under the active combination."""
    f = stored_findings(s, d).filter("variant = 'cumulative:500'").select("trace_id", F.col("kind").alias("reason")).distinct()
    return f.unionByName(d7(s, d))


@query("ref_b19_snapshot", f"WITH {R} SELECT service_id, fingerprint, count(*) AS n, CAST(sum(duration_us) AS BIGINT) AS path_sum, min(duration_us) AS path_min, max(duration_us) AS path_max, min(start_us) AS first_seen FROM r GROUP BY ALL")
def b19(s, d):
    """The learned state of cumulative:50 after all traces, as saved and loaded."""
    x = written(baseline.learned(traces(s, d), ["cumulative:50"]), "snapshot")
    return x.select("service_id", "fingerprint", "n", "path_sum", "path_min", "path_max", "first_seen")


@query("ref_b19_all_states")
def b19_all(s, d):
    """The learned state of every combination."""
    return baseline.learned(traces(s, d), combinations())


_NOW = 1718582400000000


@query("ref_z9_hot_tier", f"WITH {R}, {FI} SELECT trace_id FROM r WHERE {_NOW} - start_us < 900000000 OR ({_NOW} - start_us < 9000000000 AND trace_id IN (SELECT trace_id FROM f))")
def z9(s, d):
    return rollup.tiers(traces(s, d), stored_findings(s, d).select("trace_id"), _NOW).select("trace_id")


@query("ref_z9_rollup_tiers", f"WITH {R}, w AS (SELECT start_us - start_us % 900000000 AS window_start, service_id, fingerprint, count(*) AS trace_count FROM r GROUP BY ALL) SELECT *, CASE WHEN window_start + 900000000 < {_NOW} - 3600000000 THEN 'cold' ELSE 'warm' END AS tier FROM w")
def z9_rollups(s, d):
    """Rollups of all windows by tier: those of the last hour stay warm, the others are moved to cold storage and read back from there."""
    x = written(rollup.tier_of(rollup.rollups(written(traces(s, d), "traces")), _NOW), "tiers")
    moved, path = x.filter("tier = 'cold'"), new_path(s, "cold-tier")
    cold.write_hours(moved, "window_start", path)
    back = cold.read_hours(s, path, x.schema, "window_start", 0, _NOW)
    return back.select(*x.columns).unionByName(x.filter("tier = 'warm'")).select("window_start", "service_id", "fingerprint", "trace_count", "tier")


@query("ref_z8_retained_hours", f"WITH {R}, h AS (SELECT DISTINCT strftime(make_timestamp(start_us), '%Y-%m-%d-%H') AS hour FROM r), n AS (SELECT unnest(range(97)) AS i), b AS (SELECT ({_NOW} - {_NOW} % 3600000000) + i * 3600000000 - 86400000000 AS y FROM n), c AS (SELECT y - 86400000000 * (CASE dayofweek(make_timestamp(y)) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END) AS base FROM b) SELECT hour FROM h WHERE hour IN (SELECT strftime(make_timestamp(base + o * 3600000000), '%Y-%m-%d-%H') FROM c, (SELECT unnest([-2, -1, 0, 1, 2]) AS o))")
def z8(s, d):
    """Hours that a comparison within the next four days can still reach."""
    hours = traces(s, d).select(F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd-HH").alias("hour")).distinct()
    start = _NOW - _NOW % 3_600_000_000
    reach = s.range(97).select(F.explode(rollup.comparison_hours(F.lit(start) + F.col("id") * F.lit(3_600_000_000))).alias("hour")).distinct()
    return hours.join(reach, "hour", "left_semi")
