"""Percentiles of very large numeric columns from signed logarithmic buckets.

A value x falls into bucket ``ceil(log_g |x|)`` of its sign, g = (1 + a) / (1 - a), zero into its own. All of a bucket lies within the
relative distance a of the bucket's estimate ``2 g^i / (g + 1)``, so every percentile read from the counts is within
``a * |exact|`` of the exact one (up to the rounding of a double; the exact one is the value of rank ``floor(q (n - 1))``, counted from 0).
Counts of equal buckets add up: sketches of files, days or partitions combine to the sketch of the whole, in any order.

A group has at most about ``log(max / min) / a`` buckets per sign (under 5,000 for bigints at 1 %), however many rows it has; counts are
combined before the shuffle, so a group that holds a third of all rows costs each task its buckets only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.workdir import written

ALPHA = 0.01
#: Added to the exponents so that codes of either sign never meet; infinite values have codes of their own.
_OFFSET, _INF = 1 << 30, 1 << 40


def bucket(x: Column, alpha: float = ALPHA) -> Column:
    """Code of the bucket of ``x``: rises with ``x``; null for null and NaN."""
    x = x.cast("double")
    log_g = math.log((1 + alpha) / (1 - alpha))
    i = F.ceil(F.log(F.abs(x)) / F.lit(log_g)).cast("bigint") + F.lit(_OFFSET)
    i = F.when(F.abs(x) == float("inf"), F.lit(_INF)).otherwise(i)
    return F.when(F.isnan(x) | x.isNull(), None).when(x == 0, F.lit(0).cast("bigint")).when(x > 0, i).otherwise(-i)


def estimate(code: Column, alpha: float = ALPHA) -> Column:
    """The value that stands for a bucket."""
    g = (1 + alpha) / (1 - alpha)
    mag = F.lit(2 / (g + 1)) * F.pow(F.lit(g), (F.abs(code) - F.lit(_OFFSET)).cast("double"))
    mag = F.when(F.abs(code) == _INF, F.lit(float("inf"))).otherwise(mag)
    return F.when(code == 0, F.lit(0.0)).when(code > 0, mag).otherwise(-mag)


def sketch(df: DataFrame, by: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """``by, code, n``: how many values of each group fall into each bucket.

    Null and NaN values are not counted; nulls in ``by`` form a group. Empty input gives no rows."""
    return df.select(*by, bucket(F.col(value), alpha).alias("code")).filter("code is not null").groupBy(*by, "code").agg(F.count("*").alias("n"))


def combine(sketches: list[DataFrame], by: list[str]) -> DataFrame:
    """The sketch of the whole from sketches of its parts; ``by`` may leave out columns (a day, a file) to sum over them."""
    return reduce(DataFrame.unionByName, [s.select(*by, "code", "n") for s in sketches]).groupBy(*by, "code").agg(F.sum("n").alias("n"))


def _hits(sketched: DataFrame, by: list[str], qs: list[float]) -> DataFrame:
    """``by, q, n, code, skip``: the bucket that holds each percentile of each group, and how many values of the bucket come before it."""
    up = Window.partitionBy(*by).orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    cum = sketched.withColumn("_upto", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(every))
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.floor(F.lit(float(q)) * (F.col("_all") - 1)).alias("r")) for q in qs])
    here = F.filter(wanted, lambda w: (w["r"] < F.col("_upto")) & (w["r"] >= F.col("_upto") - F.col("n")))
    got = cum.select(*by, "_all", "code", (F.col("_upto") - F.col("n")).alias("_before"), F.explode(here).alias("_w"))
    return got.select(*by, F.col("_w.q").alias("q"), F.col("_all").alias("n"), "code", (F.col("_w.r") - F.col("_before")).alias("skip"))


def percentiles(sketched: DataFrame, by: list[str], qs: list[float], alpha: float = ALPHA) -> DataFrame:
    """``by, q, n, estimate`` for each group and each of ``qs`` (0 to 1); ``n`` is the number of values of the group."""
    return _hits(sketched, by, qs).select(*by, "q", "n", estimate(F.col("code"), alpha).alias("estimate"))


def checked(df: DataFrame, by: list[str], value: str, qs: list[float], alpha: float = ALPHA) -> DataFrame:
    """``by, q, n, exact, estimate, within``: each percentile beside the exact one, and whether it keeps the bound.

    The sketch tells which bucket holds the exact value; only the values of those buckets are counted, equal ones together, and ranked."""
    hits = written(_hits(sketch(df, by, value, alpha), by, qs), "percentile-buckets")
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in [*by, "code"]])
    rows = df.select(*by, F.col(value).alias("_x"), bucket(F.col(value), alpha).alias("code"))
    wanted = hits.select(*by, "code").distinct()
    vals = rows.join(wanted, same(rows, wanted), "left_semi").groupBy(*by, "code", "_x").agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*by, "code").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("_upto", F.sum("_c").over(up))
    on = same(hits, vals) & (hits["skip"] < vals["_upto"]) & (hits["skip"] >= vals["_upto"] - vals["_c"])
    x, e = F.col("_x").cast("double"), estimate(hits["code"], alpha)
    near = F.abs(e - x) <= F.abs(x) * F.lit(alpha * (1 + 1e-9))
    return hits.join(vals, on).select(*[hits[c] for c in by], "q", "n", F.col("_x").alias("exact"), e.alias("estimate"), near.alias("within"))
