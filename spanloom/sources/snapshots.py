"""What was learned, saved between runs: states of services by generation, hourly buckets by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.workdir import drop


def save(states: DataFrame, path: str, generation: int) -> None:
    """Writes one generation of states (``service_id, state``); the same generation written again replaces itself, older ones stay to fall back on."""
    states.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/generation={generation}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of each service."""
    x = spark.read.parquet(path)
    return x.groupBy("service_id").agg(F.max_by("state", "generation").alias("state"))


def fallback(saved: DataFrame, combination: str) -> DataFrame:
    """``service_id, combination``: the saved state that ``combination`` starts from in each service: its own, else that of the lowest threshold of its variant,
    else one of before combinations (an empty or null name). A service with none of these has no row."""
    variant = combination.split(":")[0]
    name = F.coalesce("combination", F.lit(""))
    t = F.expr("try_cast(try_element_at(split(coalesce(combination, ''), ':'), 2) as bigint)")
    rank = F.when(name == combination, F.struct(F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"))).when(name.startswith(variant + ":"), F.struct(F.lit(1).alias("a"), t.alias("b"))).when(name == "", F.struct(F.lit(2).alias("a"), F.lit(0).cast("bigint").alias("b")))
    return saved.withColumn("_r", rank).filter("_r is not null").groupBy("service_id").agg(F.min_by(name, "_r").alias("combination"))


def save_hours(hours: DataFrame, path: str) -> None:
    """Writes hourly buckets (``hour`` and others) by hour. Hours that come are replaced whole, others stay."""
    hours.repartition("hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(path)


def load_hours(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.option("basePath", path).parquet(path)
    return x.withColumn("hour", F.col("hour").cast("string"))


def drop_hours(spark: SparkSession, path: str, hours: list[str]) -> None:
    """Removes hours; one that is not there is no error."""
    for h in hours:
        drop(spark, f"{path}/hour={h}")
