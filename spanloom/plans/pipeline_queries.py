"""Queries p1, p3, p4, p5 and p7 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.ids import span_hex, trace_hex
from spanloom.operators import dedup, hierarchy, late, orphans, skew
from spanloom.operators.traces import counting_rows
from spanloom.sources.tables import table, usable_spans
from spanloom.workdir import written


def _refs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in orphans.TRACE_REFS}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references of spans to parents and of four tables to traces."""
    return orphans.find_orphans(table(spark, d, "spans"), _refs(spark, d))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """References and dangling ones per table and period."""
    return orphans.orphan_counts(table(spark, d, "spans"), _refs(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Spans on a cycle of parents or below one."""
    return hierarchy.cycles(hierarchy.hierarchy(usable_spans(table(spark, d, "spans"))))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(usable_spans(table(spark, d, "spans")), with_path=True)


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of every span."""
    return _tree(spark, d).select(
        trace_hex(F.col("th"), F.col("tl")).alias("trace_id"), span_hex(F.col("s")).alias("span_id"), span_hex(F.col("root")).alias("root_id"),
        "depth", "orphan", span_hex(F.col("cycle")).alias("cycle_span_id"), F.col("n_below").alias("n_descendants"), "path",
    )


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every span with every span below it and the distance."""
    return hierarchy.descendants(_tree(spark, d))


def _with_pending(spans: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT * FROM {spans} UNION ALL SELECT * FROM {pending}", spans=spans, pending=late.pending_records(table(spark, d, "pending_traces")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that arrived beyond the cut-off of their period."""
    records = late.span_records(late.span_copies(table(spark, d, "spans")))
    return late.late_records(_with_pending(spark.sql("SELECT *, 0L AS value FROM {r}", r=records), spark, d))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return late.changes(_with_pending(late.span_copies(table(spark, d, "spans")), spark, d))


def p4_triangle(spark: SparkSession, d: str) -> DataFrame:
    """Changes of totals per period of the event and period of the arrival."""
    return late.triangle(_changes(spark, d))


def p4_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Every corrected total of every period."""
    return late.revisions(late.triangle(_changes(spark, d)))


SHARE = 0.05


def _trace_keys(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    rows = written(counting_rows(table(spark, d, "traces"), "service_id", "fingerprint"), "counting-rows")
    keys = rows.select("th", "tl", F.expr("stack(2, 'service_id', service_id, 'fingerprint', fingerprint) as (key_kind, key_value)"))
    return keys, rows.count()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Services and fingerprints that hold at least 5 % of the traces."""
    keys, n = _trace_keys(spark, d)
    per_key = skew.spread_aggregate(keys, ["key_kind", "key_value"], ["th", "tl"], [F.count("*").alias("n")], [F.sum("n").alias("n")], n=2 * n)
    return per_key.filter((F.col("n") >= F.lit(SHARE) * F.lit(n)) & F.col("key_value").isNotNull()).select("key_kind", "key_value")


def p5_per_service(spark: SparkSession, d: str) -> DataFrame:
    """Traces, errors and durations per service, with the parts of its id."""
    rows = written(counting_rows(table(spark, d, "traces"), "service_id", "duration_us", "has_error"), "counting-rows")
    groups = table(spark, d, "service_groupings").select("service_id", "service_identity", "env")
    joined = skew.spread_join(rows, groups, ["service_id"], ["th", "tl"])
    return joined.groupBy("service_id", "service_identity", "env").agg(
        F.count("*").alias("n_traces"), F.coalesce(F.count_if("has_error"), F.lit(0)).alias("n_errors"), F.sum("duration_us").alias("duration_sum"), F.max("duration_us").alias("duration_max")
    )


def p5_per_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Traces, errors and durations per fingerprint."""
    rows = written(counting_rows(table(spark, d, "traces"), "fingerprint", "duration_us", "has_error"), "counting-rows")
    return skew.spread_aggregate(
        rows, ["fingerprint"], ["th", "tl"],
        [F.count("*").alias("n"), F.count_if("has_error").alias("e"), F.sum("duration_us").alias("t"), F.max("duration_us").alias("m")],
        [F.sum("n").alias("n_traces"), F.sum("e").alias("n_errors"), F.sum("t").alias("duration_sum"), F.max("m").alias("duration_max")],
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Spans delivered more than once."""
    return dedup.repeated(usable_spans(table(spark, d, "spans")))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """The valid copy of every span."""
    rows = usable_spans(table(spark, d, "spans"), "operation_name", "duration", "service_name")
    return dedup.one_copy_each(rows).select(
        trace_hex(F.col("th"), F.col("tl")).alias("trace_id"), span_hex(F.col("s")).alias("span_id"), F.coalesce(span_hex(F.col("p")), F.lit("")).alias("parent_id"),
        "operation_name", "duration", "service_name", "arrival", "copies",
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p3_found, p3_hierarchy, p3_descendants, p4_found, p4_triangle, p4_revisions, p5_found, p5_per_service, p5_per_fingerprint, p7_found, p7_copies)}

# --- the same in SQL for DuckDB -----------------------------------------------------------------

_HEX = "ltrim(regexp_replace(regexp_replace({c}, '^\\s*0[xX]', ''), '[\\s-]', '', 'g'), '0')"


def _id(c: str, width: int) -> str:
    return f"lpad(lower({_HEX.format(c=c)}), {width}, '0')"


_US = "CASE " + " ".join(
    f"WHEN start_time >= {1704067200 * u} AND start_time < {1830297600 * u} THEN start_time {'*' if u <= 10**6 else '//'} {10**6 // u if u <= 10**6 else u // 10**6}" for u in (1, 10**3, 10**6, 10**9)
) + " END"

#: ``u``: usable rows with canonical ids; ``v``: valid copies.
SPANS_SQL = f"""
u AS (SELECT {_id('trace_id', 32)} AS t, {_id('span_id', 16)} AS s, nullif({_id("coalesce(parent_id, '')", 16)}, '0000000000000000') AS p,
             {_US} AS event_us, arrival, start_time, duration, operation_name, service_name, tags
      FROM spans WHERE trim(coalesce(trace_id, '')) <> '' AND trim(coalesce(span_id, '')) <> ''),
v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY t, s ORDER BY arrival DESC) = 1)
"""
_PERIOD = "{c} - {c} % 900000000"
_REFS = """
refs AS (SELECT 'traces' AS src, trace_id, epoch_us(created_at) AS us FROM traces UNION ALL
         SELECT 'pending_traces', trace_id, epoch_us(first_seen) FROM pending_traces UNION ALL
         SELECT 'anomalies', trace_id, epoch_us(created_at) FROM anomalies UNION ALL
         SELECT 'deviations', trace_id, epoch_us(created_at) FROM deviations)
"""
_LATE = f"""
rec AS (SELECT 'spans' AS src, t AS trace_id, s AS span_id, arg_max(event_us, arrival) AS ev, min(arrival) AS arr FROM (SELECT t, s, coalesce(event_us, -1) AS event_us, arrival FROM u) GROUP BY t, s
        UNION ALL
        SELECT 'pending_traces', trace_id, '', min(least(epoch_us(first_seen), epoch_us(last_seen))), max(greatest(epoch_us(first_seen), epoch_us(last_seen))) FROM pending_traces GROUP BY trace_id),
late AS (SELECT src, trace_id, span_id FROM rec WHERE ev > 0 AND arr > ev - ev % 900000000 + 4500000000)
"""
#: Every copy's own change, then summed: the engine reduces the copies of one arrival period first.
_CELLS = f"""
cop AS (SELECT DISTINCT 'spans' AS src, t AS trace_id, s AS span_id, event_us AS ev, arrival AS arr, coalesce(duration, 0) AS value FROM u WHERE arrival IS NOT NULL
        UNION ALL
        SELECT 'pending_traces', trace_id, '', min(least(epoch_us(first_seen), epoch_us(last_seen))), max(greatest(epoch_us(first_seen), epoch_us(last_seen))),
               max(greatest(epoch_us(first_seen), epoch_us(last_seen))) - min(least(epoch_us(first_seen), epoch_us(last_seen))) FROM pending_traces GROUP BY trace_id),
st AS (SELECT *, ev - ev % 900000000 AS period, lead(arr) OVER w AS next_arr, lag(ev - ev % 900000000) OVER w AS old_period, lag(value) OVER w AS old_value FROM cop WINDOW w AS (PARTITION BY src, trace_id, span_id ORDER BY arr, ev NULLS FIRST, value)),
ch AS (SELECT src, period, arr, 1 AS n, value AS total FROM st UNION ALL SELECT src, old_period, arr, -1, -old_value FROM st WHERE old_period IS NOT NULL),
inside AS (SELECT src, period, arr - arr % 900000000 AS arrival_period, n, total FROM ch WHERE period IS NOT NULL AND arr <= period + 4500000000),
cells AS (SELECT src, period, arrival_period, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS total FROM inside GROUP BY ALL)
"""
_LAST = "cr AS (SELECT * FROM traces QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY created_at DESC) = 1)"
_TREE = f"""
e AS (SELECT v.t, v.s, v.p, q.s AS up, v.p IS NOT NULL AND q.s IS NULL AS dangles FROM v LEFT JOIN v q ON v.t = q.t AND v.p = q.s),
tree AS (SELECT t, s, s AS root, 0 AS depth, dangles AS orphan, s AS path FROM e WHERE up IS NULL
         UNION ALL
         SELECT e.t, e.s, tree.root, tree.depth + 1, tree.orphan, tree.path || '/' || e.s FROM tree JOIN e ON e.t = tree.t AND e.up = tree.s)
"""
_WALK = """
loose AS (SELECT e.t, e.s, e.up FROM e ANTI JOIN tree USING (t, s)),
walk AS (SELECT t, s, up AS x, 1 AS k FROM loose UNION ALL SELECT w.t, w.s, l.up, w.k + 1 FROM walk w JOIN loose l ON l.t = w.t AND l.s = w.x
         WHERE w.k < 2 * (SELECT count(*) FROM loose l2 WHERE l2.t = w.t)),
cyc AS (SELECT t, s, min(x) AS c FROM walk w WHERE w.k >= (SELECT count(*) FROM loose l2 WHERE l2.t = w.t) GROUP BY t, s)
"""

ORACLE = {
    "p1_found": f"WITH {SPANS_SQL}, {_REFS} SELECT 'spans' AS src, v.t AS trace_id, v.s AS span_id FROM v WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.t = v.t AND u.s = v.p)"
    " UNION ALL SELECT DISTINCT src, trace_id, '' FROM refs WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.t = refs.trace_id)",
    "p1_counts": f"WITH {SPANS_SQL}, {_REFS}, a AS (SELECT 'spans' AS src, {_PERIOD.format(c='event_us')} AS period_us, NOT EXISTS (SELECT 1 FROM u WHERE u.t = v.t AND u.s = v.p) AS lost FROM v WHERE p IS NOT NULL"
    f" UNION ALL SELECT src, {_PERIOD.format(c='us')}, NOT EXISTS (SELECT 1 FROM u WHERE u.t = refs.trace_id) FROM refs) SELECT src, period_us, count(*) AS n_refs, count(*) FILTER (lost) AS n_dangling FROM a GROUP BY ALL",
    "p3_found": f"WITH RECURSIVE {SPANS_SQL}, {_TREE}, {_WALK} SELECT t AS trace_id, s AS span_id, c AS cycle_span_id FROM cyc",
    "p3_hierarchy": f"WITH RECURSIVE {SPANS_SQL}, {_TREE}, {_WALK}, d AS (SELECT t, x, count(*) AS n FROM (SELECT t, depth, unnest(string_split(path, '/')) AS x FROM tree) GROUP BY ALL)"
    " SELECT tree.t AS trace_id, tree.s AS span_id, root AS root_id, depth, orphan, NULL::VARCHAR AS cycle_span_id, d.n - 1 AS n_descendants, path FROM tree JOIN d ON d.t = tree.t AND d.x = tree.s"
    " UNION ALL SELECT t, s, NULL, NULL, false, c, NULL, NULL FROM cyc",
    "p3_descendants": f"WITH RECURSIVE {SPANS_SQL}, {_TREE} SELECT t AS trace_id, a AS ancestor_id, s AS span_id, depth - i + 1 AS distance FROM (SELECT t, s, depth, unnest(string_split(path, '/')) AS a, generate_subscripts(string_split(path, '/'), 1) AS i FROM tree) WHERE a <> s",
    "p4_found": f"WITH {SPANS_SQL}, {_LATE} SELECT src, trace_id, span_id FROM late",
    "p4_triangle": f"WITH {SPANS_SQL}, {_CELLS} SELECT * FROM cells WHERE n <> 0 OR total <> 0",
    "p4_revisions": f"WITH {SPANS_SQL}, {_CELLS}, kept AS (SELECT * FROM cells WHERE n <> 0 OR total <> 0) SELECT src, period, arrival_period, CAST(row_number() OVER w AS INT) AS revision, n AS n_added, CAST(sum(n) OVER w AS BIGINT) AS n_so_far, CAST(sum(total) OVER w AS BIGINT) AS total_so_far,"
    " arrival_period = max(arrival_period) OVER (PARTITION BY src, period) AS is_final FROM kept WINDOW w AS (PARTITION BY src, period ORDER BY arrival_period ROWS UNBOUNDED PRECEDING)",
    "p5_found": f"WITH {_LAST}, k AS (SELECT 'service_id' AS key_kind, service_id AS key_value FROM cr UNION ALL SELECT 'fingerprint', fingerprint FROM cr) SELECT key_kind, key_value FROM k WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT count(*) FROM cr)",
    "p5_per_service": f"WITH {_LAST} SELECT service_id, service_identity, env, count(*) AS n_traces, count(*) FILTER (has_error) AS n_errors, CAST(sum(duration_us) AS BIGINT) AS duration_sum, max(duration_us) AS duration_max FROM cr LEFT JOIN service_groupings USING (service_id) GROUP BY ALL",
    "p5_per_fingerprint": f"WITH {_LAST} SELECT fingerprint, count(*) AS n_traces, count(*) FILTER (has_error) AS n_errors, CAST(sum(duration_us) AS BIGINT) AS duration_sum, max(duration_us) AS duration_max FROM cr GROUP BY ALL",
    "p7_found": f"WITH {SPANS_SQL} SELECT t AS trace_id, s AS span_id, max(arrival) AS arrival FROM u GROUP BY t, s HAVING count(*) > 1",
    "p7_copies": f"WITH {SPANS_SQL}, c AS (SELECT t, s, count(*) AS copies FROM u GROUP BY ALL) SELECT v.t AS trace_id, v.s AS span_id, coalesce(p, '') AS parent_id, operation_name, duration, service_name, arrival, copies FROM v JOIN c ON c.t = v.t AND c.s = v.s",
}
