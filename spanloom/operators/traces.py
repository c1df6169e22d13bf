"""Trace rows: the row that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import trace_bits


def counting_rows(traces: DataFrame, *cols: str) -> DataFrame:
    """``th, tl`` and ``cols`` of each trace's row with the latest ``created_at``; a null one counts as the earliest.

    Rows without a trace id count for nothing; rows tied at the latest instant resolve to the greatest content."""
    th, tl = trace_bits(F.col("trace_id"))
    rows = traces.select(th.alias("th"), tl.alias("tl"), F.struct(F.col("created_at").alias("_at"), *cols).alias("r")).filter("th is not null")
    return rows.groupBy("th", "tl").agg(F.max("r").alias("r")).select("th", "tl", *[f"r.{c}" for c in cols])
