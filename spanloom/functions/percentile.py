"""Percentiles by the engine's own rule: the value of rank ``int((n - 1) * p)`` of the sorted samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_low(samples: Column, p: float) -> Column:
    """Percentile of an array; ``p`` is clamped to 0..1, an empty or null array gives 0. Built-in percentiles follow another rule."""
    return nearest_low_sorted(F.sort_array(samples), p)


def nearest_low_sorted(s: Column, p: float) -> Column:
    """As ``nearest_low`` for an array that is sorted already, so several percentiles share one sort."""
    p = min(1.0, max(0.0, p))
    at = F.floor((F.size(s) - 1).cast("double") * F.lit(p)).cast("int") + 1
    return F.when(s.isNull() | (F.size(s) == 0), F.lit(0)).otherwise(F.try_element_at(s, at))


def weighted(pairs: Column, p: float) -> Column:
    """Of an array of (x, w): the smallest x whose cumulative weight exceeds ``(W - 1) p``; the largest x if none does; 0 if empty."""
    p = min(1.0, max(0.0, p))
    s = F.array_sort(pairs)
    total = F.aggregate(s, F.lit(0.0), lambda a, e: a + e["w"].cast("double"))
    zero = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("bigint").alias("x"))
    hit = F.aggregate(
        s, zero,
        lambda a, e: F.struct((a["cum"] + e["w"].cast("double")).alias("cum"), F.when(a["x"].isNotNull(), a["x"]).when(a["cum"] + e["w"].cast("double") > (total - 1) * F.lit(p), e["x"].cast("bigint")).alias("x")),
        lambda a: a["x"],
    )
    return F.when(F.size(pairs) <= 0, F.lit(0).cast("bigint")).otherwise(F.coalesce(hit, F.array_max(F.transform(pairs, lambda e: e["x"].cast("bigint")))))
