"""Tables written between the steps of a job.

They lie in the folder named by ``spark.checkpoint.dir``, which all executors share, so a lost
executor costs nothing that was written. Only where the session names none (tests, a laptop) a
temporary folder of this machine is made and set as the checkpoint folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a slash at its end."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other step uses; removed at the end of the process."""
    path = f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return path


class scratch:
    """Within it, what is written is removed at its end: ``with scratch(spark): ...`` around work whose results have left."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.at = len(_written)

    def __exit__(self, *exc) -> None:
        for _, path in _written[self.at :]:
            drop(self.spark, path)
        del _written[self.at :]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and returns the reading of it (lineage is cut)."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes one written table; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_table(df: DataFrame) -> None:
    """Removes the files of a table that ``written`` returned, once no later step reads it."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop(df.sparkSession, f)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended already
            return


def plan_bytes(df: DataFrame) -> int:
    """Bytes that the plan of ``df`` reads: the sum over its leaves.

    Estimates further up multiply over joins; leaves of unknown size (local data, RDDs) count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def partitions_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Shuffle partitions for ``df``: the session's number, or more where a part would exceed ``bytes_each``."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(base, min(200_000, -(-plan_bytes(df) // bytes_each)))
