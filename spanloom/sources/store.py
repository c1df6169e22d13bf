"""Cleaned spans laid out for point reads: folders by bucket of the trace id, sorted by it within, so that a read of one trace opens one folder and the row
groups whose range holds the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import assembly
from spanloom.sources.cold import BUCKETS, bucket_of
from spanloom.workdir import partitions_for


def build(raw: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the valid spans of ``raw``. A busy bucket is several tasks' and files'."""
    x = assembly.valid_spans(raw).withColumn("bucket", bucket_of(F.col("trace_id"), buckets))
    n = partitions_for(raw)
    x.repartition(max(n, buckets), "bucket", F.substring("trace_id", -10, 1)).sortWithinPartitions("bucket", "trace_id", "start_time").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def spans_of(spark: SparkSession, path: str, trace_id: str, buckets: int = BUCKETS) -> DataFrame:
    """The spans of one trace; an id that is no canonical one has none."""
    try:
        bucket = int(trace_id[-8:], 16) % buckets
    except ValueError:
        bucket = -1
    return spark.read.parquet(path).filter((F.col("bucket") == bucket) & (F.col("trace_id") == trace_id)).drop("bucket")
