"""Cold storage and snapshots: hour-partitioned JSON, bucketed Parquet layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 128


def _hour_parts(us: Column) -> dict[str, Column]:
    t = F.timestamp_micros(us)
    return {"year": F.date_format(t, "yyyy"), "month": F.date_format(t, "MM"), "day": F.date_format(t, "dd"), "hour": F.date_format(t, "HH")}


def write_hours(df: DataFrame, us: str, path: str, kind: str = "json") -> None:
    """Writes ``df`` below ``year=/month=/day=/hour=`` of the instant in ``us``, compressed; one task per hour and part."""
    parts = _hour_parts(F.col(us))
    x = df.withColumns(parts).repartition(*parts, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(4)))
    x.write.mode("append").partitionBy(*parts).option("compression", "gzip" if kind == "json" else "zstd").format(kind).save(path)


def read_hours(spark: SparkSession, path: str, schema, us: str, start_us: int, end_us: int, kind: str = "json") -> DataFrame:
    """Rows with ``start_us <= us < end_us``; whole hours outside are pruned by their folders, unreadable files skipped."""
    raw = spark.read.schema(schema).option("ignoreCorruptFiles", "true").format(kind).load(path)
    key = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 4 if c == "year" else 2, "0") for c in ("year", "month", "day", "hour")])
    bound = lambda x: F.date_format(F.timestamp_micros(F.lit(x)), "yyyy-MM-dd-HH")
    return raw.filter((key >= bound(start_us)) & (key <= bound(end_us)) & (F.col(us) >= start_us) & (F.col(us) < end_us))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """``objects, bytes`` below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("length").agg(F.count("*").alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def bucket_of(trace_hex: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a trace by the last digits of its id."""
    return F.pmod(F.conv(F.substring(trace_hex, -8, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
