"""Queries p2, p6, p8, p9 and p10 over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import logsketch, mojibake, packing, topn, treebpe
from spanloom.operators.traces import counting_rows
from spanloom.sources.tables import table, usable_spans
from spanloom.workdir import new_path, written

QS = [0.25, 0.5, 0.75, 0.9, 0.99]
N = 5


def _utc_day(us: Column) -> Column:
    """The UTC day of an instant in microseconds, whatever the session's time zone."""
    day = F.lit(86_400_000_000)
    return F.date_from_unix_date(F.call_function("div", us - F.pmod(us, day), day).cast("int"))


def _named_durations(spans: DataFrame) -> DataFrame:
    """``service_name, duration, arrival`` of each span's valid copy: TESTDATA counts a span once, by that copy.

    Names go through the aggregation as 64-bit hashes, so that it hashes fixed-width rows; they come back by a join with the different names. Should two
    names share a hash, the names themselves are carried."""
    u = usable_spans(spans, "service_name", "duration")
    at = F.coalesce("arrival", F.lit(-(2**63)))
    name = F.col("service_name")
    code = F.when(name.isNotNull(), F.xxhash64(name))
    names = written(spans.filter(name.isNotNull()).select(name, code.alias("_code")).distinct(), "names")
    if names.groupBy("_code").count().filter("count > 1").limit(1).count():
        g = u.groupBy("th", "tl", "s").agg(F.max_by(F.struct("service_name", "duration"), at).alias("r"), F.max("arrival").alias("arrival"))
        return g.select("r.service_name", "r.duration", "arrival")
    g = u.groupBy("th", "tl", "s").agg(F.max_by(code, at).alias("_code"), F.max_by("duration", at).alias("duration"), F.max("arrival").alias("arrival"))
    return g.join(names, "_code", "left").select("service_name", "duration", "arrival")


def _durations(spark: SparkSession, d: str) -> DataFrame:
    """``kind, key, day, value`` of both columns: each span once by its valid copy, each trace once by the row that counts.

    The day is that of the copy's arrival or of ``created_at``. Unusable rows belong to no span."""
    copies = _named_durations(table(spark, d, "spans"))
    spans = copies.select(F.lit("service_name").alias("kind"), F.col("service_name").alias("key"), _utc_day(F.col("arrival")).alias("day"), F.col("duration").alias("value"))
    rows = counting_rows(table(spark, d, "traces"), "fingerprint", "duration_us", "created_at")
    traces = rows.select(F.lit("fingerprint").alias("kind"), F.col("fingerprint").alias("key"), _utc_day(F.unix_micros("created_at")).alias("day"), F.col("duration_us").alias("value"))
    return spans.unionByName(traces)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of ``duration`` per service and ``duration_us`` per fingerprint, within 1 %."""
    s = logsketch.sketch(_durations(spark, d), ["kind", "key"], "value")
    return logsketch.percentiles(s, ["kind", "key"], QS).withColumn("estimate", F.round("estimate", 3))


def p2_from_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from sketches of separate days, combined."""
    days = logsketch.sketch(_durations(spark, d), ["kind", "key", "day"], "value")
    return logsketch.percentiles(logsketch.combine([days], ["kind", "key"]), ["kind", "key"], QS).withColumn("estimate", F.round("estimate", 3))


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """The exact percentiles, and whether those of the sketch keep their bound."""
    return logsketch.checked(_durations(spark, d), ["kind", "key"], "value", QS).select("kind", "key", "q", "n", "exact", "within")


def _findings(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for src in ("anomalies", "deviations"):
        # null parts make a null group, which does not compete
        g = F.concat(F.lit(src), F.lit("\t"), _utc_day(F.unix_micros("created_at")).cast("string"), F.lit("\t"), F.col("service_id"))
        x = table(spark, d, src).select(g.alias("g"), "id", "score")
        out = x if out is None else out.unionByName(x)
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The five highest scores of each service and day, in both tables."""
    return topn.top_of_each(_findings(spark, d), N).select(F.substring_index("g", "\t", 1).alias("src"), "id")


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with group, score and rank."""
    g = F.split("g", "\t", 3)
    return topn.top_of_each(_findings(spark, d), N).select(g[0].alias("src"), g[1].alias("day"), g[2].alias("service_id"), "rank", "id", "score")


def p6_skipping(spark: SparkSession, d: str) -> DataFrame:
    """Row groups per clustered file, and those that had to be read."""
    return topn.skipping(topn.clustered(_findings(spark, d), new_path(spark, "topn")), N)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every text."""
    return treebpe.encode_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that had to be split over containers."""
    return p9_packing(spark, d).filter("piece = 1").select("doc_id")


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    """Container of every text or piece of one."""
    return packing.pack_texts(table(spark, d, "documents"))


def p9_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the ten best neighbours in the whole corpus that a seed can reach; seeds are the rows whose id is divisible by 100."""
    return packing.recall(table(spark, d, "documents"), F.col("doc_id") % 100 == 0)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts garbled by a wrong encoding."""
    return mojibake.repair(table(spark, d, "documents")).filter("garbled").select("doc_id")


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled texts with the text that was meant, as far as it can be restored."""
    return mojibake.repair(table(spark, d, "documents")).filter("garbled").select("doc_id", "restored", "fixed")


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_from_days, p2_exact, p6_found, p6_ranked, p6_skipping, p8_ids, p9_found, p9_packing, p9_recall, p10_found, p10_repaired)}

_G = (1 + logsketch.ALPHA) / (1 - logsketch.ALPHA)
_VALUES = """
WITH u AS (SELECT lpad(lower(ltrim(regexp_replace(regexp_replace(trace_id, '^\\s*0[xX]', ''), '[\\s-]', '', 'g'), '0')), 32, '0') AS t, lpad(lower(ltrim(regexp_replace(regexp_replace(span_id, '^\\s*0[xX]', ''), '[\\s-]', '', 'g'), '0')), 16, '0') AS s, *
           FROM spans WHERE trim(coalesce(trace_id, '')) <> '' AND trim(coalesce(span_id, '')) <> ''),
x AS (SELECT 'service_name' AS kind, service_name AS key, CAST(duration AS DOUBLE) AS v FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY t, s ORDER BY arrival DESC) = 1)
      UNION ALL SELECT 'fingerprint', fingerprint, CAST(duration_us AS DOUBLE) FROM (SELECT * FROM traces QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY created_at DESC) = 1))
"""
_SKETCH = f"""{_VALUES},
b AS (SELECT kind, key, sign(v) AS s, CASE WHEN v = 0 THEN 0 ELSE ceil(ln(abs(v)) / {math.log(_G)!r}) END AS i, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY kind, key ORDER BY s, s * i ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY kind, key) AS total FROM b),
q AS (SELECT unnest({QS}::DOUBLE[]) AS q)
SELECT kind, key, q, CAST(total AS BIGINT) AS n, round(s * 2 * pow({_G!r}, i) / ({_G!r} + 1), 3) AS estimate
FROM c, q WHERE floor(q * (total - 1)) < upto AND floor(q * (total - 1)) >= upto - n
"""
_TOP = f"""
WITH x AS (SELECT 'anomalies' AS src, id, service_id, score, created_at FROM anomalies UNION ALL SELECT 'deviations', id, service_id, score, created_at FROM deviations),
y AS (SELECT DISTINCT src, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, service_id, id, score FROM x WHERE isfinite(score) AND id IS NOT NULL AND service_id IS NOT NULL AND created_at IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY src, day, service_id ORDER BY score DESC, id) AS INT) AS rank FROM y)
"""
ORACLE = {
    "p2_percentiles": _SKETCH,
    "p2_from_days": _SKETCH,
    "p2_exact": f"""{_VALUES}, l AS (SELECT kind, key, list_sort(list(CAST(v AS BIGINT))) AS s FROM x WHERE v IS NOT NULL GROUP BY ALL), q AS (SELECT unnest({QS}::DOUBLE[]) AS q)
    SELECT kind, key, q, CAST(len(s) AS BIGINT) AS n, s[CAST(floor(q * (len(s) - 1)) AS BIGINT) + 1] AS exact, true AS within FROM l, q""",
    "p6_found": f"{_TOP} SELECT src, id FROM r WHERE rank <= {N}",
    "p6_ranked": f"{_TOP} SELECT src, day, service_id, rank, id, score FROM r WHERE rank <= {N}",
}
