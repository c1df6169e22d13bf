"""Learning and detection over traces made of orders and their lines, which have few services, frequent paths and all kinds of findings.

A trace is an order: its service the order's status, its path the line statuses, its duration made of the price, its branches its lines. Every few
thousand orders a path breaks out for ten minutes, and one is seen a handful of times. The SQL beside each query follows the rules with
windows and recursion; the engine folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import baseline, rollup
from spanloom.operators.config import combinations
from spanloom.plans.engine_queries import in_ring
from spanloom.sources import snapshots
from spanloom.sources.tables import table
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


# --- traces of orders ----------------------------------------------------------------------------

_BASE = 1_704_412_800_000_000
#: Seconds between orders: close together for windows of five minutes, apart for hours of the day before.
NEAR, FAR = 2, 20
_LINE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def order_traces(s, d: str, step: int) -> DataFrame:
    """``trace_id, service_id, fingerprint, start_us, duration_us, branches, recursive``; of repeated lines the greatest row counts."""
    one = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct(*_LINE)).alias("r"))
    key = F.col("l_orderkey")
    lines = one.select(key, F.col("r.l_linestatus").alias("status"), ((F.col("r.l_quantity").cast("bigint") * 1000 + F.col("l_linenumber")) * F.when(F.pmod(key, F.lit(167)) == 0, 8).otherwise(1)).alias("us"))
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    per = lines.join(o, lines.l_orderkey == o.o_orderkey).groupBy("o_orderkey", "o_orderstatus", "o_totalprice").agg(
        F.array_join(F.array_sort(F.collect_list("status")), "").alias("path"),
        F.array_sort(F.collect_list(F.struct(F.concat("o_orderstatus", F.lit(":order->"), "status", F.lit(":line")).alias("branch_key"), F.col("us").alias("duration_us")))).alias("branches"),
    )
    k = F.col("o_orderkey")
    burst = F.pmod(k, F.lit(5000)).between(4000, 4299) & (F.pmod(k, F.lit(3)) == 0)
    odd = F.pmod(k, F.lit(2500)).between(2400, 2429)
    path = F.when(burst, F.concat(F.lit("burst"), F.call_function("div", k, F.lit(5000)))).when(odd, F.concat(F.lit("odd"), F.call_function("div", k, F.lit(2500)))).otherwise(F.col("path"))
    us = (F.lit(80_000) + F.floor(F.col("o_totalprice") / F.lit(20.0))) * F.when(F.pmod(k, F.lit(167)) == 0, 6).otherwise(1)
    return per.select(
        F.lpad(k.cast("string"), 12, "0").alias("trace_id"), F.col("o_orderstatus").alias("service_id"), path.alias("fingerprint"), (F.lit(_BASE) + k * F.lit(step * 1_000_000)).alias("start_us"),
        us.cast("bigint").alias("duration_us"), "branches", F.lit(False).alias("recursive"),
    )


def _sql(step: int) -> str:
    """The same traces as ``r``, and ``b``, one row per branch."""
    return f"""
ln AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _LINE)}) = 1),
o AS (SELECT o_orderkey AS k, o_orderstatus AS service_id, o_totalprice AS price, string_agg(l_linestatus, '' ORDER BY l_linestatus) AS path FROM ln JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT lpad(CAST(k AS VARCHAR), 12, '0') AS trace_id, service_id, CASE WHEN k % 5000 BETWEEN 4000 AND 4299 AND k % 3 = 0 THEN 'burst' || (k // 5000) WHEN k % 2500 BETWEEN 2400 AND 2429 THEN 'odd' || (k // 2500) ELSE path END AS fingerprint,
             {_BASE} + k * {step * 1_000_000} AS start_us, CAST((80000 + floor(price / 20.0::DOUBLE)) * CASE WHEN k % 167 = 0 THEN 6 ELSE 1 END AS BIGINT) AS duration_us FROM o),
b AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS trace_id, o.service_id, o.service_id || ':order->' || l_linestatus || ':line' AS branch_key,
             (CAST(l_quantity AS BIGINT) * 1000 + l_linenumber) * CASE WHEN k % 167 = 0 THEN 8 ELSE 1 END AS us, l_linenumber AS line FROM ln JOIN o ON l_orderkey = k)"""


_O = "ORDER BY start_us"
_PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _known_sql(t: int) -> str:
    """``x``: each trace with what is known before it at threshold ``t``; ``w``: windows of five minutes from their first trace on."""
    return f"""
p AS (SELECT *, row_number() OVER (PARTITION BY service_id {_O}) - 1 AS n_service, row_number() OVER (PARTITION BY service_id, fingerprint {_O}) - 1 AS n_path,
             min(start_us) OVER (PARTITION BY service_id, fingerprint {_O} {_PREV}) AS first_seen FROM r),
w(service_id, ws) AS (SELECT service_id, min(start_us) FROM r GROUP BY service_id UNION ALL SELECT w.service_id, (SELECT min(start_us) FROM r WHERE r.service_id = w.service_id AND r.start_us > w.ws + 300000000) FROM w WHERE ws IS NOT NULL),
wn AS (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY ws) AS wn FROM w WHERE ws IS NOT NULL),
g AS (SELECT p.*, wn.wn, (n_service + 1 >= {t} AND (n_path + 1) * 100 > n_service + 1) AS hit, max(n_path + 1) OVER (PARTITION BY p.service_id {_O}) AS best,
             min(fingerprint) OVER (PARTITION BY p.service_id, n_path {_O}) AS top_of FROM p ASOF JOIN wn ON p.service_id = wn.service_id AND p.start_us >= wn.ws),
tot AS (SELECT service_id, wn, count(*) AS n FROM g GROUP BY ALL), per AS (SELECT service_id, wn, fingerprint, count(*) AS n FROM g GROUP BY ALL),
h AS (SELECT *, CASE WHEN n_path + 1 = best THEN top_of END AS lead_now, row_number() OVER (PARTITION BY service_id, wn {_O}) - 1 AS w_total, row_number() OVER (PARTITION BY service_id, wn, fingerprint {_O}) - 1 AS w_n,
             lag(wn) OVER (PARTITION BY service_id {_O}) AS lw FROM g),
i AS (SELECT *, last_value(lead_now IGNORE NULLS) OVER (PARTITION BY service_id {_O} ROWS UNBOUNDED PRECEDING) AS top FROM h),
x AS (SELECT i.* EXCLUDE (wn), coalesce(bool_or(hit) OVER (PARTITION BY i.service_id, i.fingerprint {_O} {_PREV}), false)
               OR (n_service >= {t} AND 100 * count(*) FILTER (n_service < {t}) OVER (PARTITION BY i.service_id, i.fingerprint) > {t}) AS known_good,
             coalesce(last_value(CASE WHEN n_service + 1 >= {t} AND best * 10 > n_service + 1 THEN top END IGNORE NULLS) OVER (PARTITION BY i.service_id {_O} {_PREV}), '') AS canonical,
             coalesce(CASE WHEN i.wn = lw THEN w_total ELSE t1.n END, 0) AS recent_total, coalesce(CASE WHEN i.wn = lw THEN w_n ELSE p1.n END, 0) AS recent_n, coalesce(p2.n / t2.n::DOUBLE, 0) AS previous
      FROM i LEFT JOIN tot t1 ON t1.service_id = i.service_id AND t1.wn = lw LEFT JOIN per p1 ON p1.service_id = i.service_id AND p1.wn = lw AND p1.fingerprint = i.fingerprint
             LEFT JOIN tot t2 ON t2.service_id = i.service_id AND t2.wn = lw - 1 LEFT JOIN per p2 ON p2.service_id = i.service_id AND p2.wn = lw - 1 AND p2.fingerprint = i.fingerprint)"""


@query(
    "ref_b6_known_before",
    f"WITH RECURSIVE {_sql(NEAR)}, {_known_sql(50)} SELECT trace_id, service_id, fingerprint, n_service, n_path, known_good, canonical, CAST(recent_total AS BIGINT) AS recent_total, CAST(recent_n AS BIGINT) AS recent_n, round(previous, 9) AS previous FROM x",
)
def b6(s, d):
    """What the active combination knows before each trace: counts, known good and canonical (sticky), the recent window."""
    return baseline.before(order_traces(s, d, NEAR), "cumulative:50").withColumn("previous", F.round("previous", 9))


def _deviations_sql(t: int, known: str, freq: str = "n_path / n_service::DOUBLE") -> str:
    """``dv``: deviations at threshold ``t`` with their summaries."""
    return f"""{known},
y AS (SELECT *, n_path = 0 OR start_us - first_seen < 600000000 AS is_new, {freq} AS freq, recent_n / nullif(recent_total, 0)::DOUBLE AS new FROM x),
z AS (SELECT *, recent_total >= 20 AND CASE WHEN previous > 0 THEN abs(new - previous) > 0.1 OR abs(new - previous) / previous > 0.5 ELSE new > 0.1 END AS shifted FROM y WHERE n_service >= {t}),
ty AS (SELECT *, CASE WHEN NOT is_new AND n_path < {t} THEN NULL WHEN is_new AND freq = 0 THEN 'new_path' WHEN known_good THEN CASE WHEN shifted AND new < previous THEN 'frequency_drop' END
                      WHEN freq < 0.3 AND shifted AND new > previous AND new > 0.05 THEN 'frequency_spike' WHEN freq < 0.3 AND freq < 0.001 THEN 'rare_path' END AS type FROM z),
ks AS (SELECT trace_id, list_sort(list_distinct(list(branch_key))) AS keys FROM b GROUP BY trace_id),
ex AS (SELECT p.service_id, p.fingerprint, keys FROM p JOIN ks USING (trace_id) WHERE n_path = 0),
df AS (SELECT ty.*, list_sort(list_filter(ks.keys, lambda q: NOT list_contains(coalesce(ex.keys, []), q))) AS added, list_sort(list_filter(coalesce(ex.keys, []), lambda q: NOT list_contains(ks.keys, q))) AS gone
       FROM ty JOIN ks USING (trace_id) LEFT JOIN ex ON ex.service_id = ty.service_id AND ex.fingerprint = ty.canonical WHERE type IS NOT NULL),
dv AS (SELECT trace_id, service_id, fingerprint, canonical, type,
              CASE type WHEN 'new_path' THEN 1.0 WHEN 'frequency_drop' THEN (previous - new) / previous WHEN 'frequency_spike' THEN new - previous ELSE 1.0 - freq * 100 END AS score,
              '[' || type || '] ' || CASE type WHEN 'new_path' THEN 'New execution path detected (never seen before)'
                WHEN 'frequency_drop' THEN printf('Path frequency dropped: %.1f%% → %.1f%%', previous * 100, new * 100) WHEN 'frequency_spike' THEN printf('Rare path spiking: %.1f%% → %.1f%%', previous * 100, new * 100)
                ELSE CASE WHEN len(added) + len(gone) = 0 THEN 'Rare execution path' ELSE rtrim(CASE WHEN len(added) > 0 THEN 'Added: [' || array_to_string(added, ', ') || ']. ' ELSE '' END || CASE WHEN len(gone) > 0 THEN 'Missing: [' || array_to_string(gone, ', ') || ']. ' ELSE '' END) END END AS summary
       FROM df)"""


def _deviations(s, d: str, step: int, combo: str) -> DataFrame:
    return baseline.findings(order_traces(s, d, step), [combo]).filter("kind = 'deviation'").select("trace_id", "service_id", "fingerprint", "canonical", "type", F.round("score", 9).alias("score"), "summary")


def _one_type(sql: str, kind: str) -> str:
    return f"{sql} SELECT trace_id, service_id, fingerprint, canonical, type, round(CAST(score AS DOUBLE), 9) AS score, summary FROM dv WHERE type = '{kind}'"


_DEV50 = f"WITH RECURSIVE {_sql(NEAR)}, {_deviations_sql(50, _known_sql(50))}"
_DEV500 = f"WITH RECURSIVE {_sql(NEAR)}, {_deviations_sql(500, _known_sql(500))}"


def _kind_query(name: str, kind: str, combo: str, sql: str) -> None:
    def f(s, d):
        return _deviations(s, d, NEAR, combo).filter(F.col("type") == kind)

    f.__doc__ = f"Findings of type {kind} of {combo}, with score and summary."
    query(name, _one_type(sql, kind))(f)


for _name, _kind in (("d3a", "new_path"), ("d3b", "frequency_drop"), ("d3c", "frequency_spike"), ("d3d", "rare_path")):
    _kind_query(f"ref_{_name}_{_kind}_50", _kind, "cumulative:50", _DEV50)
    _kind_query(f"ref_{_name}_{_kind}_500", _kind, "cumulative:500", _DEV500)


@query("ref_d3_ewma_deviations", f"{_DEV50} SELECT trace_id, service_id, fingerprint, canonical, type, round(CAST(score AS DOUBLE), 9) AS score, summary FROM dv")
def d3_ewma(s, d):
    """All deviations of ewma:50: what it counts is what the cumulative variant counts (D3 to D3f)."""
    return _deviations(s, d, NEAR, "ewma:50")


# --- durations -----------------------------------------------------------------------------------

_EARLIER = """x AS (SELECT trace_id, service_id, fingerprint, start_us, duration_us, row_number() OVER q - 1 AS n, list(duration_us) OVER (PARTITION BY service_id, fingerprint ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
      min(duration_us) OVER (PARTITION BY service_id, fingerprint ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low, max(duration_us) OVER (PARTITION BY service_id, fingerprint ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
      FROM r WINDOW q AS (PARTITION BY service_id, fingerprint ORDER BY start_us))"""


def _ring_sql(of: str, n: str, limit: int) -> str:
    return f"list_sort(CASE WHEN {n} <= {limit} THEN {of} WHEN {n} < {2 * limit} THEN list_concat({of}[1:1], {of}[-{limit - 1}:]) ELSE {of}[-{limit}:] END)"


def _z(x: str, ref: str, p25: str, flat: str) -> str:
    return f"CASE WHEN {ref} = {p25} THEN {flat} ELSE abs(0.6745::DOUBLE * ({x} - {ref}) / (({ref} - {p25}) / 1.35::DOUBLE)) END"


_AT = "s[CAST(floor((len(s) - 1) * {p}) AS INT) + 1]"
_FLAT = "CASE WHEN duration_us = ref OR high = low THEN 0 ELSE (duration_us - ref) / ((high - low) / 4.0::DOUBLE) END"


def _anomaly_sql(t: int, flat: str = _FLAT) -> str:
    """``an``: anomalies against each path's own samples."""
    return f"""{_EARLIER}, rg AS (SELECT *, {_ring_sql('l', 'n', 1000)} AS s FROM x WHERE n >= {t}), rf AS (SELECT *, {_AT.format(p=0.75)} AS ref, {_AT.format(p=0.25)} AS p25 FROM rg),
an AS (SELECT * FROM (SELECT trace_id, service_id, fingerprint, start_us, {_z('duration_us', 'ref', 'p25', flat)} AS score FROM rf) WHERE score >= 3.5)"""


def _anomalies(s, d: str, step: int, combo: str) -> DataFrame:
    return baseline.findings(order_traces(s, d, step), [combo]).filter("kind = 'anomaly'").select("trace_id", "service_id", "fingerprint", F.round("score", 6).alias("score"))


for _v, _t, _f in (("cumulative", 50, _FLAT), ("cumulative", 100, _FLAT), ("cumulative", 500, _FLAT), ("ewma", 50, "0")):

    def _q(s, d, combo=f"{_v}:{_t}"):
        return _anomalies(s, d, NEAR, combo)

    _q.__doc__ = f"Anomalies of {_v}:{_t}."
    query(f"ref_d5_{_v}_{_t}", f"WITH {_sql(NEAR)}, {_anomaly_sql(_t, _f)} SELECT trace_id, service_id, fingerprint, round(CAST(score AS DOUBLE), 6) AS score FROM an")(_q)

_SLOW = f"""
ev AS (SELECT b.*, r.start_us, row_number() OVER (PARTITION BY b.service_id, branch_key ORDER BY r.start_us, us) AS seq, first_value(us) OVER (PARTITION BY b.trace_id, branch_key ORDER BY us) AS x0 FROM b JOIN r USING (trace_id)),
ls AS (SELECT service_id, branch_key, list(us ORDER BY seq) AS l FROM ev GROUP BY ALL),
be AS (SELECT ev.trace_id, ev.branch_key, ev.us, min(seq) OVER (PARTITION BY ev.trace_id, ev.branch_key) - 1 AS n, ls.l FROM ev JOIN ls USING (service_id, branch_key) WHERE ev.trace_id IN (SELECT trace_id FROM an)),
bs AS (SELECT trace_id, branch_key, us, list_sort(CASE WHEN n <= 100 THEN l[1:n] WHEN n < 200 THEN list_concat(l[1:1], l[n - 98:n]) ELSE l[n - 99:n] END) AS s FROM be WHERE n >= 10),
bf AS (SELECT *, {_AT.format(p=0.75)} AS ref, {_AT.format(p=0.25)} AS p25, {_AT.format(p=0.5)} AS p50 FROM bs),
bz AS (SELECT *, greatest(us - p50, 0) AS excess, {_z('us', 'ref', 'p25', 'CASE WHEN us = ref THEN 0 ELSE 10 END')} AS z FROM bf),
tp AS (SELECT trace_id, list(branch_key ORDER BY excess DESC, branch_key)[1:5] AS slow FROM bz WHERE z > 2 GROUP BY trace_id)"""


@query("ref_d6_slow_branches_50", f"WITH {_sql(NEAR)}, {_anomaly_sql(50)}, {_SLOW} SELECT an.trace_id, round(CAST(score AS DOUBLE), 6) AS score, coalesce(slow, []) AS slow_branches FROM an LEFT JOIN tp USING (trace_id)")
def d6(s, d):
    """Anomalies with the branches that were slower than usual."""
    f = baseline.findings(order_traces(s, d, NEAR), ["cumulative:50"]).filter("kind = 'anomaly'")
    return f.select("trace_id", F.round("score", 6).alias("score"), "slow_branches")


# --- the hour of the day before ------------------------------------------------------------------

_HOURS = """
hr AS (SELECT *, start_us // 3600000000 AS hour FROM r),
hb AS (SELECT service_id, hour, count(*) AS total FROM hr GROUP BY ALL), hp AS (SELECT service_id, hour, fingerprint, count(*) AS n, list(duration_us) AS l FROM hr GROUP BY ALL),
cq AS (SELECT trace_id, service_id, fingerprint, (start_us - 86400000000 * (1 + CASE dayofweek(make_timestamp(start_us - 86400000000)) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END)) // 3600000000 + k AS hour FROM r, (SELECT unnest([-2, -1, 0, 1, 2]) AS k)),
sh AS (SELECT cq.trace_id, coalesce(hp.n, 0) / hb.total::DOUBLE AS share FROM cq JOIN hb USING (service_id, hour) LEFT JOIN hp USING (service_id, hour, fingerprint) QUALIFY row_number() OVER (PARTITION BY cq.trace_id ORDER BY hb.total DESC, cq.hour) = 1),
mp AS (SELECT trace_id, list_sort(flatten(list(l))) AS s FROM cq JOIN hp USING (service_id, hour, fingerprint) GROUP BY trace_id)"""


@query(
    "ref_d3_same_hour_deviations",
    f"WITH RECURSIVE {_sql(FAR)}, {_HOURS}, {_deviations_sql(50, _known_sql(50), 'coalesce((SELECT share FROM sh WHERE sh.trace_id = x.trace_id), n_path / n_service::DOUBLE)')} SELECT trace_id, service_id, fingerprint, canonical, type, round(CAST(score AS DOUBLE), 9) AS score, summary FROM dv",
)
def d3_sty(s, d):
    """Deviations of same_time_yesterday:50: the path's share in the busiest comparison hour counts where there is one."""
    return _deviations(s, d, FAR, "same_time_yesterday:50")


@query(
    "ref_d5_same_hour_anomalies",
    f"WITH {_sql(FAR)}, {_HOURS}, {_EARLIER}, ow AS (SELECT x.* EXCLUDE (low, high), CASE WHEN len(mp.s) >= 50 THEN mp.s ELSE {_ring_sql('l', 'n', 1000)} END AS s, CASE WHEN len(mp.s) >= 50 THEN mp.s[1] ELSE low END AS low, CASE WHEN len(mp.s) >= 50 THEN mp.s[-1] ELSE high END AS high"
    f" FROM x LEFT JOIN mp USING (trace_id) WHERE n >= 50 OR len(mp.s) >= 50), rf AS (SELECT *, {_AT.format(p=0.75)} AS ref, {_AT.format(p=0.25)} AS p25 FROM ow)"
    f" SELECT trace_id, service_id, fingerprint, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT *, {_z('duration_us', 'ref', 'p25', _FLAT)} AS score FROM rf) WHERE score >= 3.5",
)
def d5_sty(s, d):
    """Anomalies of same_time_yesterday:50 against the merged samples of the comparison hours, else the path's own."""
    return _anomalies(s, d, FAR, "same_time_yesterday:50")


@query("ref_d_orders_all")
def d_all(s, d):
    """All findings of the twenty combinations."""
    f = baseline.findings(order_traces(s, d, NEAR), combinations())
    return f.select("trace_id", "service_id", "fingerprint", "combination", "type", F.round("score", 9).alias("score"))


# --- how paths and counts age --------------------------------------------------------------------


def _fold_sql(step: str, first: str = "{'n': 1::BIGINT, 't': x, 'at': 0::BIGINT, 'x': 0::BIGINT}") -> str:
    return f"""
e AS (SELECT service_id, fingerprint, list({{'n': 1::BIGINT, 't': duration_us, 'at': start_us, 'x': duration_us}} ORDER BY start_us) AS l FROM r GROUP BY ALL),
f AS (SELECT service_id, fingerprint, list_reduce(l, lambda a, b: {step}) AS s FROM e) SELECT service_id, fingerprint, s.n AS path_n, s.t AS path_sum FROM f"""


_EWMA = "{'n': a.n + 1, 't': CAST(trunc((0.1::DOUBLE * b.x + 0.9::DOUBLE * a.t / a.n) * (a.n + 1)) AS BIGINT), 'at': b.at, 'x': b.x}"
_F = "CASE WHEN b.at - a.at > 86400000000 THEN 0.5::DOUBLE WHEN b.at > a.at AND a.n > 1 THEN 1.0::DOUBLE - (b.at - a.at) / 86400000000::DOUBLE * 0.05::DOUBLE ELSE 1.0::DOUBLE END"
_SLIDE = f"{{'n': CAST(trunc(a.n * ({_F})) AS BIGINT) + 1, 't': CAST(trunc(a.t * ({_F})) AS BIGINT) + b.x, 'at': b.at, 'x': b.x}}"
_DECAY = "{'n': CASE WHEN (a.n + 1) % 100 = 0 AND a.n + 1 > 100 THEN CAST(trunc((a.n + 1) * 0.95::DOUBLE) AS BIGINT) ELSE a.n + 1 END, 't': CASE WHEN (a.n + 1) % 100 = 0 THEN CAST(trunc((a.t + b.x) * 0.95::DOUBLE) AS BIGINT) ELSE a.t + b.x END, 'at': b.at, 'x': b.x}"


def _path_query(name: str, variant: str, step: str) -> None:
    def f(s, d):
        return baseline.learned(order_traces(s, d, NEAR), [f"{variant}:50"]).select("service_id", "fingerprint", "path_n", "path_sum")

    f.__doc__ = f"Count and sum of each path after all traces, as {variant} ages them."
    query(name, f"WITH {_sql(NEAR)}, {_fold_sql(step)}")(f)


_path_query("ref_b12_ewma_path", "ewma", _EWMA)
_path_query("ref_b14_sliding_path", "sliding_window", _SLIDE)
_path_query("ref_b16_decay_path", "exponential_decay", _DECAY)


def _counts_sql(aged: str) -> str:
    """Counts of all paths of a service trace by trace; a path is aged by the time since it was seen, and counts twice when it comes."""
    return f"""WITH RECURSIVE {_sql(NEAR)},
t AS (SELECT service_id, fingerprint, start_us, row_number() OVER (PARTITION BY service_id ORDER BY start_us) AS i FROM r), ps AS (SELECT DISTINCT service_id, fingerprint FROM r),
st(service_id, fingerprint, i, n, seen) AS (SELECT service_id, fingerprint, 0::BIGINT, 0::BIGINT, NULL::BIGINT FROM ps UNION ALL
  SELECT st.service_id, st.fingerprint, t.i, CASE WHEN st.fingerprint = t.fingerprint THEN st.n + 2 WHEN st.seen IS NULL THEN st.n ELSE {aged} END, CASE WHEN st.fingerprint = t.fingerprint THEN t.start_us ELSE st.seen END
  FROM st JOIN t ON t.service_id = st.service_id AND t.i = st.i + 1)
SELECT service_id, fingerprint, n FROM st QUALIFY i = max(i) OVER (PARTITION BY service_id)"""


def _count_query(name: str, variant: str, aged: str) -> None:
    def f(s, d):
        return baseline.learned(order_traces(s, d, NEAR), [f"{variant}:50"]).select("service_id", "fingerprint", "n")

    f.__doc__ = f"Count of each path after all traces, as {variant} ages it."
    query(name, _counts_sql(aged))(f)


_count_query("ref_b13_sliding_counts", "sliding_window", "CASE WHEN t.start_us - st.seen > 86400000000 THEN 0 WHEN st.n > 1 THEN CAST(trunc(st.n * (1.0::DOUBLE - (t.start_us - st.seen) / 86400000000::DOUBLE * 0.1::DOUBLE)) AS BIGINT) ELSE st.n END")
_count_query("ref_b15_decay_counts", "exponential_decay", "CASE WHEN st.n > 1 THEN CAST(trunc(st.n * exp(-ln(2::DOUBLE) / 86400::DOUBLE * ((t.start_us - st.seen) / 1000000::DOUBLE))) AS BIGINT) ELSE st.n END")


# --- saved and taken up again --------------------------------------------------------------------


@query("ref_s21_resumed_deviations", f"{_DEV50} SELECT trace_id, service_id, fingerprint, canonical, type, round(CAST(score AS DOUBLE), 9) AS score, summary FROM dv")
def s21(s, d):
    """Deviations of all traces, learned in two parts: the first part's state is saved, and the second part starts from it."""
    t = written(order_traces(s, d, NEAR), "order-traces")
    cut = F.lit(_BASE + 9_000 * NEAR * 1_000_000)
    one, two = t.filter(F.col("start_us") < cut), t.filter(F.col("start_us") >= cut)
    path = new_path(s, "snapshots")
    snapshots.save(baseline.snapshots(one, ["cumulative:50"]), path, 1)
    saved = snapshots.load(s, path)
    both = baseline.findings(one, ["cumulative:50"]).unionByName(baseline.findings(two, ["cumulative:50"], saved=saved))
    return both.filter("kind = 'deviation'").select("trace_id", "service_id", "fingerprint", "canonical", "type", F.round("score", 9).alias("score"), "summary")


@query("ref_s21_resumed_anomalies", f"WITH {_sql(NEAR)}, {_anomaly_sql(50)} SELECT trace_id, service_id, fingerprint, round(CAST(score AS DOUBLE), 6) AS score FROM an")
def s21_anomalies(s, d):
    """Anomalies from a state that was saved twice: the later generation counts."""
    t = written(order_traces(s, d, NEAR), "order-traces")
    at = [F.lit(_BASE + n * NEAR * 1_000_000) for n in (4_000, 9_000)]
    parts = [t.filter(F.col("start_us") < at[0]), t.filter((F.col("start_us") >= at[0]) & (F.col("start_us") < at[1])), t.filter(F.col("start_us") >= at[1])]
    path, out = new_path(s, "snapshots"), None
    saved = None
    for i, p in enumerate(parts):
        f = written(baseline.findings(p, ["cumulative:50"], saved=saved), "findings")
        out = f if out is None else out.unionByName(f)
        if i < 2:
            snapshots.save(baseline.snapshots(p, ["cumulative:50"], saved=saved), path, i)
            saved = snapshots.load(s, path)
    return out.filter("kind = 'anomaly'").select("trace_id", "service_id", "fingerprint", F.round("score", 6).alias("score"))


_KEEP_FROM = _BASE + 30 * 3_600_000_000


@query(
    "ref_s22_saved_hours",
    f"WITH {_sql(FAR)} SELECT strftime(make_timestamp(start_us), '%Y-%m-%d-%H') AS hour, service_id, fingerprint, count(*) AS n, CAST(sum(duration_us) AS BIGINT) AS duration_sum, min(duration_us) AS duration_min, max(duration_us) AS duration_max FROM r WHERE start_us >= {_KEEP_FROM} GROUP BY ALL",
)
def s22(s, d):
    """Hourly buckets saved in two steps: the hours that the second step touches are written anew, hours that nothing compares to any more are removed."""
    t = written(order_traces(s, d, FAR), "order-traces")
    path = new_path(s, "hours")
    cut = _BASE + 40 * 3_600_000_000 + 1_234_000_000
    snapshots.save_hours(rollup.hourly(t.filter(F.col("start_us") < cut)), path)
    touched = t.filter(F.col("start_us") >= cut - cut % 3_600_000_000)
    snapshots.save_hours(rollup.hourly(touched), path)
    hours = [r.hour for r in t.filter(F.col("start_us") < _KEEP_FROM).select(F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd-HH").alias("hour")).distinct().collect()]
    snapshots.drop_hours(s, path, hours)
    return snapshots.load_hours(s, path).select("hour", "service_id", "fingerprint", "n", "duration_sum", "duration_min", "duration_max")


@query(
    "ref_b8_branch_rings",
    f"WITH {_sql(NEAR)}, q AS (SELECT b.service_id, branch_key, us, row_number() OVER (PARTITION BY b.service_id, branch_key ORDER BY start_us, b.trace_id, us) AS seq, count(*) OVER (PARTITION BY b.service_id, branch_key) AS n_all FROM b JOIN r USING (trace_id))"
    " SELECT service_id, branch_key, CAST(max(n_all) AS BIGINT) AS n, count(*) AS kept, CAST(sum(us) AS BIGINT) AS kept_sum FROM q WHERE n_all <= 100 OR (n_all < 200 AND (seq = 1 OR seq > n_all - 99)) OR (n_all >= 200 AND seq > n_all - 100) GROUP BY ALL",
)
def b8(s, d):
    """What the rings of 100 hold of each branch after all traces."""
    x = order_traces(s, d, NEAR).select("service_id", "trace_id", "start_us", F.explode("branches").alias("b")).select("service_id", "trace_id", "start_us", "b.*")
    x = rollup.numbered(x, ["service_id", "branch_key"], ["start_us", "trace_id", "duration_us"], "start_us")
    g = x.filter(in_ring("n_all", "seq", 100)).groupBy("service_id", "branch_key")
    return g.agg(F.max("n_all").alias("n"), F.count("*").alias("kept"), F.sum("duration_us").alias("kept_sum"))
