"""The tables of a data folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.event_time import event_us
from spanloom.functions.ids import span_text, text_bits, trace_text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def usable_spans(spans: DataFrame, *extra: str) -> DataFrame:
    """Rows of ``spans`` with a trace and a span id: ``th, tl, s`` (bits of the ids), ``p`` (parent, null for a
    root), ``event_us`` and ``arrival``, then the columns named in ``extra`` as they are.

    Rows without one of the two ids (null, blank, no hexadecimal number) are unusable and left out."""
    # texts first, then numbers: each text is mended once, not once per use
    texts = spans.select(
        trace_text(F.col("trace_id")).alias("_t"), span_text(F.col("span_id")).alias("_s"), span_text(F.col("parent_id")).alias("_p"),
        event_us(F.col("start_time")).alias("event_us"), F.col("arrival").cast("bigint").alias("arrival"), *extra,
        # a number that may not be computed twice keeps the filter where it is: below, it would mend every text again
        F.monotonically_increasing_id().alias("_once"),
    ).filter("_t is not null and _s is not null and _once >= 0")
    th, tl = text_bits(F.col("_t"))
    bits = texts.select(th.alias("th"), tl.alias("tl"), F.conv("_s", 16, -10).cast("bigint").alias("s"), F.conv("_p", 16, -10).cast("bigint").alias("p"), "event_us", "arrival", *extra)
    return bits.withColumn("p", F.nullif("p", F.lit(0)))


def valid_edges(usable: DataFrame) -> DataFrame:
    """One row per span by its valid copy: ``th, tl, s, p, event_us``. Map-side combined, one shuffle."""
    # nulls never win a max_by, so a null arrival counts as the earliest
    at = F.coalesce(F.col("arrival"), F.lit(-(2**63)))
    return usable.groupBy("th", "tl", "s").agg(F.max_by("p", at).alias("p"), F.max_by("event_us", at).alias("event_us"))
