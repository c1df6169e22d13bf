"""Per-key results where a few keys hold most records: fragment-replicate by estimated load.

The load of the keys is estimated from a sample of the rows, ``SAMPLE_PER_TASK`` for each task; only the plan rests on it, never a result. Keys above the
load of one task are large: each is split into as many shards as its load needs. The small keys are hashed into buckets. Large shards and buckets are then
packed into tasks, heaviest first into the least loaded task. At most ``2 * tasks`` keys can exceed half a task's load, and there is a fixed
number of buckets per task, so the plan of the packing has a few entries per task whatever the data. It is broadcast only while it has
no more than ``BROADCAST_ENTRIES``; beyond that it is joined. The matching side goes only to the tasks that hold its key: once for a small key,
once per shard for a large one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.workdir import partitions_for

#: Buckets of small keys per task.
BUCKETS_PER_TASK = 8
#: Rows of the sample per task: a key that fills half a task is estimated from a thousand of them.
SAMPLE_PER_TASK = 2_000
#: Entries of a plan that may be broadcast (some 100 bytes each).
BROADCAST_ENTRIES = 200_000


def _hash(*cols: Column, mod: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(mod)).cast("int")


def pack(loads: list[tuple[str, int]], tasks: int) -> list[int]:
    """Task of each load: the heaviest first, each to the task with the least so far."""
    heap = [(0, t) for t in range(tasks)]
    out = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i][1], loads[i][0])):
        load, t = heapq.heappop(heap)
        out[i] = t
        heapq.heappush(heap, (load + loads[i][1], t))
    return out


class Fragments:
    """The packing of one table's keys. ``key`` are its key columns; null keys are keys like any other."""

    def __init__(self, facts: DataFrame, key: list[str], tasks: int | None = None, n: int | None = None):
        """``n`` is the number of rows of ``facts`` where it is known already."""
        self.key = key
        self.tasks = tasks or partitions_for(facts)
        self.buckets = self.tasks * BUCKETS_PER_TASK
        self.total = facts.count() if n is None else n
        share = min(1.0, SAMPLE_PER_TASK * self.tasks / max(1, self.total))
        sample = facts.select(*key) if share == 1.0 else facts.select(*key).sample(share, 7)
        #: At most this many rows of one key go to one task undivided.
        self.limit = max(1, self.total // (2 * self.tasks))
        load = (F.col("_c") / F.lit(share)).cast("bigint")
        counted = sample.groupBy(*key).agg(F.count("*").alias("_c")).withColumn("_load", load)
        big = F.col("_load") > self.limit
        bucket = F.when(~big, _hash(*[F.col(c) for c in key], mod=self.buckets)).alias("_bucket")
        # one row per large key and per bucket of small ones
        named = counted.select(bucket, F.when(big, F.struct(*key)).alias("_big"), "_load")
        plan = named.groupBy("_bucket", "_big").agg(F.sum("_load").alias("_load")).collect()
        large = [(tuple(r["_big"]), r["_load"]) for r in plan if r["_bucket"] is None]
        small = [(r["_bucket"], r["_load"]) for r in plan if r["_bucket"] is not None]
        shards = [(i, k, -(-n // self.limit)) for i, (_, n) in enumerate(large) for k in range(-(-n // self.limit))]
        units = [(f"k{i}.{k}", large[i][1] // n) for i, k, n in shards] + [(f"b{b}", n) for b, n in small]
        at = pack(units, self.tasks)
        spark = facts.sparkSession
        key_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in facts.select(*key).schema)
        per_key: dict[int, list[int]] = {}
        for (i, _, _), t in zip(shards, at):
            per_key.setdefault(i, []).append(t)
        self.big = self._sized(spark.createDataFrame([(*large[i][0], ts) for i, ts in per_key.items()], f"{key_type}, _tasks array<int>"), len(shards))
        self.small = self._sized(spark.createDataFrame([(b, t) for (b, _), t in zip(small, at[len(shards) :])], "_bucket int, _task int"), len(small))
        #: What each task was given by the estimate, for checks of the balance.
        self.planned = [0] * self.tasks
        for (_, n_rows), t in zip(units, at):
            self.planned[t] += n_rows

    @staticmethod
    def _sized(plan: DataFrame, entries: int) -> DataFrame:
        return F.broadcast(plan) if entries <= BROADCAST_ENTRIES else plan

    def _placed(self, df: DataFrame, spread: Column | None) -> DataFrame:
        """``df`` with ``_task``: one of the key's shards by ``spread``, or a row for each of them."""
        big = self.big.select(*[F.col(c).alias(f"_k_{c}") for c in self.key], "_tasks")
        on = df[self.key[0]].eqNullSafe(big[f"_k_{self.key[0]}"])
        for c in self.key[1:]:
            on = on & df[c].eqNullSafe(big[f"_k_{c}"])
        x = df.join(big, on, "left").drop(*[f"_k_{c}" for c in self.key])
        x = x.withColumn("_bucket", _hash(*[F.col(c) for c in self.key], mod=self.buckets)).join(self.small, "_bucket", "left")
        if spread is not None:
            # a key of a bucket that the sample has not seen goes by its hash
            task = F.coalesce(F.element_at("_tasks", (F.pmod(spread, F.size("_tasks")) + 1).cast("int")), "_task", F.pmod("_bucket", F.lit(self.tasks)))
            return x.withColumn("_task", task.cast("int")).drop("_tasks", "_bucket")
        tasks = F.coalesce(F.array_distinct("_tasks"), F.array(F.coalesce("_task", F.pmod("_bucket", F.lit(self.tasks)).cast("int"))))
        return x.withColumn("_each", F.explode(tasks)).drop("_task", "_tasks", "_bucket").withColumnRenamed("_each", "_task")

    def facts(self, df: DataFrame, *spread_by: str) -> DataFrame:
        """The large side, each row in its task. ``spread_by`` are columns that tell rows of one key apart."""
        return self._placed(df, F.xxhash64(*[F.col(c) for c in spread_by])).repartitionById(self.tasks, "_task")

    def matching(self, df: DataFrame) -> DataFrame:
        """The matching side, replicated to the shards of its keys and nowhere else."""
        return self._placed(df, None).repartitionById(self.tasks, "_task")


def spread_aggregate(facts: DataFrame, key: list[str], spread_by: list[str], partial: list[Column], final: list[Column], tasks: int | None = None, n: int | None = None) -> DataFrame:
    """Per-key results: ``partial`` aggregates per key and task where the packing put the rows, ``final`` ones over those.

    A key's final step sees at most one row per shard. Nulls in ``key`` form a key. Empty input gives no rows."""
    f = Fragments(facts, key, tasks, n)
    return f.facts(facts, *spread_by).groupBy("_task", *key).agg(*partial).groupBy(*key).agg(*final)


def spread_join(facts: DataFrame, dims: DataFrame, key: list[str], spread_by: list[str], how: str = "left", tasks: int | None = None) -> DataFrame:
    """``facts`` joined to ``dims`` on ``key`` without a task that holds a whole large key.

    ``how`` is ``inner`` or ``left``. Null keys match nothing. Columns of ``dims`` that ``facts`` also has, other than the key, get the prefix ``dim_``."""
    f = Fragments(facts, key, tasks)
    d = dims.select(*[F.col(c).alias(c if c in key or c not in facts.columns else f"dim_{c}") for c in dims.columns])
    return f.facts(facts, *spread_by).join(f.matching(d), ["_task", *key], how).drop("_task")
