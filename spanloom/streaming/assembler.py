"""Spans to traces on a stream.

The spans of a trace leave together, once, a fixed time after the first of them came in (processing time) or after the watermark passes its first event by that
time (event time). Spans that come later open the trace again, and it leaves again under the same id; a sink that keeps the last row per id then
replaces it. State lies in RocksDB: bounded memory, and a restart goes on where it stopped. What leaves is assembled by the batch operators, so that a
trace of the stream is the trace of the batch: ``assembled`` of each micro-batch gives identity, fingerprint, branches and recursion, which learning takes.

Calls to Python and to the state cost milliseconds each, so that traces are not called one by one: a bucket of them, by a hash of the trace id, is one key. What a
micro-batch brings to a bucket is one entry of its state, packed as Arrow; each row carries the time at which its trace is due. A bucket with due traces is read
once, they leave, and the rest is put back. A bucket is held whole in a task: many open spans want more buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.operators import assembly, fingerprint, rollup, tree
from spanloom.operators.config import Config
from spanloom.session import ship
from spanloom.workdir import written

WINDOW_MS, GRACE_MS = 180_000, 300_000
FIELDS = ["span_id", "parent_id", "operation_name", "service_name", "start_time", "duration", "tags", "arrival"]
#: Tags travel as JSON text.
OUT = "trace_id string, span_id string, parent_id string, operation_name string, service_name string, start_time long, duration long, tags string, arrival long"
_LONGS = {"start_time", "duration", "arrival", "due_ms"}
_PACKED = pa.schema([(c, pa.int64() if c in _LONGS else pa.string()) for c in ("trace_id", *FIELDS, "due_ms")])
#: Keys of the state; a checkpoint goes on only with the number that it began with.
BUCKETS = 2048


def packed(rows: pd.DataFrame) -> bytes:
    """Rows of a bucket as one entry of its state. A trace's rows lie together, in the order in which they came: so they take less."""
    rows = rows.sort_values("trace_id", kind="stable")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(pa.Table.from_pandas(rows, _PACKED, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpacked(entry: bytes) -> pa.Table:
    return pa.ipc.open_stream(entry).read_all()


def last_copies(spans: pd.DataFrame) -> pd.DataFrame:
    """One row per span: the last arrival, of equal ones the last that came in."""
    return spans.sort_values("arrival", kind="stable", na_position="first").drop_duplicates(["trace_id", "span_id"], keep="last")


class Assembler(StatefulProcessor):
    """Gathers the spans of a bucket of traces; a trace leaves at the first timer after it is due. In processing time, spans whose timer never fired are given up
    ``GRACE_MS`` after they were due."""

    def __init__(self, window_ms: int = WINDOW_MS, event_time: bool = False):
        self.window_ms, self.event_time = window_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "part binary") if self.event_time else handle.getListState("spans", "part binary", self.window_ms + GRACE_MS)

    def _keep(self, rows: pd.DataFrame, at: int) -> None:
        """Puts rows into the state; a timer at the first time that one of their traces is due."""
        self.spans.appendValue((packed(rows),))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat([x[["trace_id", *FIELDS]] for x in rows], ignore_index=True)
        if self.event_time:
            # of a trace that is open already, the rows that came first tell when it is due
            due = got.groupby("trace_id", sort=False, dropna=False).start_time.transform("min").fillna(0) // 1000 + self.window_ms
        else:
            due = timerValues.getCurrentProcessingTimeInMs() + self.window_ms
        got["due_ms"] = due
        self._keep(got, int(got.due_ms.min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [unpacked(bytes(x[0])) for x in self.spans.get()]
        if not parts:
            return
        rows, now = pa.concat_tables(parts).to_pandas(), timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        if not self.event_time:  # what is put back would begin its time in the state anew
            rows = rows[rows.due_ms + GRACE_MS > now]
        due = rows.groupby("trace_id", sort=False, dropna=False).due_ms.transform("first")
        leaves = due < now  # as the timers themselves
        if not leaves.all():
            if not leaves.any() and len(rows) == sum(map(len, parts)):
                self.handle.registerTimer(int(due.min()))
                return
            self.spans.clear()
            self._keep(rows[~leaves], int(due[~leaves].min()))
        else:
            self.spans.clear()
        if leaves.any():
            yield last_copies(rows[leaves]).drop(columns="due_ms")

    def close(self) -> None:
        pass


def as_stored(spans: DataFrame) -> DataFrame:
    """The columns that the assembler takes, from spans with a map of tags; other columns (a time for a watermark) stay."""
    return spans.withColumn("tags", F.to_json("tags"))


def completed_spans(spans: DataFrame, window_ms: int = WINDOW_MS, event_time: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """The spans of finished traces, from a stream of spans (``trace_id`` and the columns of ``FIELDS``; with ``event_time`` a watermark on a time column).

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider."""
    ship(spans.sparkSession)
    keyed = spans.withColumn("trace_bucket", F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("trace_bucket").transformWithStateInPandas(
        statefulProcessor=Assembler(window_ms, event_time), outputStructType=OUT, outputMode="Update" if not event_time else "Append", timeMode="EventTime" if event_time else "ProcessingTime"
    )


def pending_spans(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Spans that a stopped query still held, read from its checkpoint: what is left to flush when it is not started again."""
    ship(spark)
    x = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "spans").load()
    part = "list_element.value.part" if "value" in x.schema["list_element"].dataType.fieldNames() else "list_element.part"
    return x.select(part).mapInArrow(_held, OUT)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in b.column(0):
            yield from unpacked(part.as_py()).drop_columns(["due_ms"]).to_batches(max_chunksize=20_000)


def assembly_ready(spans: DataFrame) -> DataFrame:
    """One row per span (the last arrival, also where a state holds copies), those with a start of zero or more and such a duration."""
    cols = [c for c in spans.columns if c not in ("trace_id", "span_id")]
    last = spans.groupBy("trace_id", "span_id").agg(F.max_by(F.struct(*cols), F.coalesce("arrival", F.lit(-(2**63)))).alias("r")).select("trace_id", "span_id", "r.*")
    return _readable(last)


def _readable(spans: DataFrame) -> DataFrame:
    return spans.filter("start_time >= 0 and duration >= 0")


def assembled(spans: DataFrame, config: Config = Config(), unique: bool = False) -> DataFrame:
    """Traces of finished spans: the columns of the batch assembly, ``fingerprint``, ``branches`` and ``recursive``. ``unique`` says that each span is there
    once, as what ``completed_spans`` lets go in a micro-batch: that saves a shuffle of them all."""
    x = spans.withColumn("tags", F.coalesce(F.from_json("tags", "map<string,string>"), F.expr(assembly.NO_TAGS)))
    x = written(_readable(x) if unique else assembly_ready(x), "finished-spans")
    # each is written by itself, so that the shuffles of one can go before the next begins
    e = written(assembly.edges(x).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("branch_key", "duration_us"))).alias("branches")), "branches")
    rec = written(tree.tree_view(x).groupBy("trace_id").agg(F.bool_or("recursive").alias("recursive")), "recursive")
    fp = written(fingerprint.fingerprints(x).select("trace_id", "fingerprint"), "fingerprints")
    return written(assembly.assemble(x, config), "assembled").join(fp, "trace_id").join(e, "trace_id", "left").join(rec, "trace_id")


def rollups_into(path: str):
    """A batch writer of partial rollups: each micro-batch of assembled traces adds one generation; a replayed batch replaces its own."""

    def write(traces: DataFrame, batch_id: int) -> None:
        rollup.rollups(written(traces, "batch-traces")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def merged_rollups(spark: SparkSession, path: str) -> DataFrame:
    """The rollups of all generations, late partials merged into their windows in the order of the batches."""
    return rollup.merge(spark.read.parquet(path), "batch")


def rollup_stream(traces: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Counts, sums, errors and extremes per 15-minute window, service and path on a stream with ``ts``; closed windows come out once, later ones are dropped
    beyond the watermark. Percentiles and sample ids need the traces: see ``rollups_into``."""
    return (
        traces.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "15 minutes"), "service_id", "fingerprint")
        .agg(F.count("*").alias("trace_count"), F.sum("span_count").alias("span_count"), F.count_if("has_error").alias("error_count"), F.sum("duration_us").alias("duration_sum"), F.min("duration_us").alias("duration_min"), F.max("duration_us").alias("duration_max"))
        .select(F.unix_micros("window.start").alias("window_start"), "service_id", "fingerprint", "trace_count", "span_count", "error_count", "duration_sum", "duration_min", "duration_max")
    )
