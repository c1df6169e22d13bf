"""File sources and sinks of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.sources import events
from spanloom.workdir import drop, exists


def new_files(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", per_trigger: int = 100, max_age: str = "7d") -> DataFrame:
    """A stream of the files of a folder: each is read once (the log is kept in the checkpoint, for ``max_age``), ``per_trigger`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("maxFileAge", max_age).format(kind).load(folder)


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Spans of recorded event streams, one file each, as they land in a folder. A file is one text: events never lie across files."""
    text = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder, wholetext=True)
    return events.span_batches(events.sse_events(text))


def upsert_into(path: str, key: str, order: str, compact_every: int = 20):
    """A batch writer that keeps, below ``path``, the last row per ``key`` by the greatest ``order``.

    A batch is one generation; every ``compact_every``-th takes the generations before it in and removes them. A replayed batch replaces its own
    generation, or, where that took others in, is there already."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, mine = batch.sparkSession, f"{path}/batch={batch_id}"
        if (batch_id + 1) % compact_every:
            _last(batch.withColumn("batch", F.lit(batch_id)), key, order).write.mode("overwrite").parquet(mine)
            return
        if exists(spark, f"{mine}/_SUCCESS"):
            return
        before = [f"{path}/batch={i}" for i in range(max(0, batch_id - compact_every), batch_id) if exists(spark, f"{path}/batch={i}/_SUCCESS")]
        rows = batch.withColumn("batch", F.lit(batch_id))
        if before:
            rows = spark.read.option("basePath", path).parquet(*before).unionByName(rows)
        _last(rows, key, order).write.mode("overwrite").parquet(mine)
        for old in before:
            drop(spark, old)

    return write


def _last(rows: DataFrame, key: str, order: str) -> DataFrame:
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, "batch")).alias("r")).select(key, "r.*")


def latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest ``order``, of equal ones that of the later batch."""
    return _last(spark.read.parquet(path), key, order)
