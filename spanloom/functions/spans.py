"""Expressions over one span."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.operators.config import DIMENSIONS, OPERATION_KEYS, Config


def lookup(tags: Column, keys: list[str]) -> Column:
    """First value in ``tags`` that is neither null nor empty, in the order of ``keys``; else ''."""
    return F.coalesce(*[F.nullif(tags[k], F.lit("")) for k in keys], F.lit(""))


def status(tags: Column) -> Column:
    """ERROR or OK. A status code decides by text order against '400' and hides the ``error`` tag; without one the tag's presence decides."""
    code = tags["http.status_code"]
    return (
        F.when(F.coalesce(F.map_contains_key(tags, "http.status_code"), F.lit(False)), F.when(F.coalesce(code, F.lit("")) >= "400", "ERROR").otherwise("OK"))
        .when(F.coalesce(F.map_contains_key(tags, "error"), F.lit(False)), "ERROR")
        .otherwise("OK")
    )


def dimensions(tags: Column, service: Column, operation: Column, config: Config = Config()) -> dict[str, Column]:
    """The nine grouping values of a span by its own tags; identity falls back to the service, operation to two tags."""
    out = {d: lookup(tags, config.keys(d)) for d in DIMENSIONS[:-1]}
    out["service_identity"] = F.coalesce(F.nullif(out["service_identity"], F.lit("")), service)
    out["operation"] = F.coalesce(F.nullif(operation, F.lit("")), lookup(tags, OPERATION_KEYS))
    return out


def signature(tags: Column, service: Column, operation: Column, config: Config = Config()) -> Column:
    """What the fingerprint sees of a span: its nine values with ``|`` between."""
    return F.concat_ws("|", *dimensions(tags, service, operation, config).values())


def join_identity(parts: list[Column], fallback: Column) -> Column:
    """Parts with ``:`` between, without empty ones at the end (inner ones stay); ``fallback`` if all are empty."""
    arr = F.array(*parts)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(len(parts))), F.lit(0), lambda acc, i: F.when(F.element_at(arr, i) != "", i).otherwise(acc))
    return F.when(last == 0, fallback).otherwise(F.array_join(F.slice(arr, 1, last), ":"))


def format_us(us: Column) -> Column:
    """A duration for reading: ``ms`` below a second, ``s`` below a minute, else ``m``; two decimals, halves up; ``0.00ms`` if not positive or no number."""
    us = us.try_cast("bigint")

    def shown(hundredth: int, unit: str) -> Column:
        # whole numbers of hundredths: no rounding of binary fractions
        h = F.call_function("div", us + F.lit(hundredth // 2), F.lit(hundredth))
        return F.concat(F.call_function("div", h, F.lit(100)).cast("string"), F.lit("."), F.lpad(F.pmod(h, F.lit(100)).cast("string"), 2, "0"), F.lit(unit))

    return F.when(us.isNull() | (us <= 0), F.lit("0.00ms")).when(us < 1_000_000, shown(10, "ms")).when(us < 60_000_000, shown(10_000, "s")).otherwise(shown(600_000, "m"))
