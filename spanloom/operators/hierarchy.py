"""Parent-child links to full hierarchies, by pointer doubling.

Every node keeps ``top``, the farthest ancestor known so far, ``next``, the parent that this one names,
and what the known part of its path amounts to: its length, its smallest id, its segment of text. A round joins ``next`` to the node of that name, takes
over its ``top`` and ``next`` and puts the two parts together, so the known part of every path doubles. A node is resolved once ``next``
is null (a root) or names no node (an orphan's subtree keeps its own top). Depths of a tree leave no gap:
a node twice as deep as known has an ancestor that the next round would resolve. So a round that resolves
nothing proves that all nodes left are on a cycle or below one; rounds grow with the logarithm of the depth. Those nodes go on doubling until the part
that they know covers their tail and the whole cycle; the smallest id known to a node on the cycle is then that of the cycle.

Links never leave their trace. Traces up to ``TASK_ROWS`` rows are therefore shuffled once and doubled
inside a task, many traces at a time, in arrays. Larger ones, whose size could exceed a task, are doubled by
distributed joins with the same recurrence and a written table after each round.

Segments of text stop doubling at ``SEGMENT`` hops, since all paths of a deep trace together may be a thousand times as large as the trace; from there
a node keeps the ancestor that its segment ends at, and paths are put together from segments as they leave, in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import span_hex, trace_hex
from spanloom.session import ship
from spanloom.workdir import drop_table, partitions_for, written

#: Rows of one trace that a task takes at most; above, the trace is doubled by joins.
TASK_ROWS = 100_000
#: Rows that a task doubles at a time (whole traces).
CHUNK_ROWS = 200_000
#: Hops that a segment of text covers at most.
SEGMENT = 64
#: Bytes of path text in a batch, about.
BATCH_BYTES = 32 << 20

SCHEMA = "th bigint, tl bigint, s bigint, root bigint, depth int, orphan boolean, cycle bigint, n_below bigint"


def _lookup(g: np.ndarray, key: np.ndarray, qg: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Position of (qg, q) among the sorted unique pairs (g, key), -1 where absent."""
    n = len(g)
    allg, allk = np.concatenate([g, qg]), np.concatenate([key, q])
    isq = np.concatenate([np.zeros(n, np.int8), np.ones(len(q), np.int8)])
    order = np.lexsort((isq, allk, allg))
    last = np.maximum.accumulate(np.where(order < n, order, -1))
    out = np.full(len(q), -1, np.int64)
    at = order >= n
    cand = last[at]
    which = order[at] - n
    ok = (cand >= 0) & (g[cand] == qg[which]) & (key[cand] == q[which])
    out[which[ok]] = cand[ok]
    return out


def resolve(th, tl, s, p, has_p, arrival, with_path: bool = False) -> dict[str, np.ndarray]:
    """Doubles the links of whole traces held in arrays; repeated (trace, span) rows count by their last arrival."""
    order = np.lexsort((arrival, s, tl, th))
    th, tl, s, p, has_p = th[order], tl[order], s[order], p[order], has_p[order]
    last = np.ones(len(s), bool)
    last[:-1] = (th[1:] != th[:-1]) | (tl[1:] != tl[:-1]) | (s[1:] != s[:-1])
    th, tl, s, p, has_p = th[last], tl[last], s[last], p[last], has_p[last]
    n = len(s)
    g = np.zeros(n, np.int64)
    if n:
        g[1:] = np.cumsum((th[1:] != th[:-1]) | (tl[1:] != tl[:-1]))
    up = np.full(n, -1, np.int64)
    up[has_p] = _lookup(g, s, g[has_p], p[has_p])
    # top: position of the farthest known ancestor; a node is resolved once its top has no parent
    top, depth = np.arange(n), np.zeros(n, np.int64)
    low = s.view(np.uint64).copy()  # smallest id on the known part
    seg, hop = [f"{x:016x}" for x in s.view(np.uint64).tolist()] if with_path else [], np.full(n, -1, np.int64)
    nxt = up.copy()
    size = np.ones(n, np.int64)  # nodes below within the distance known, the node included
    left, reach, most = np.flatnonzero(nxt >= 0), 1, 0
    while len(left) and not (most and reach >= most):
        j = nxt[left]
        if with_path and not most:
            if reach < SEGMENT:
                for x, head in zip(left.tolist(), [seg[y] for y in j.tolist()]):
                    seg[x] = head + "/" + seg[x]
            elif reach == SEGMENT:
                hop[left] = j
        if not most:  # a node of a cycle would count itself below itself
            np.add.at(size, j, size[left])
        # all right sides are read before any left side is written
        top[left], nxt[left], depth[left], low[left] = top[j], nxt[j], depth[left] + 1 + depth[j], np.minimum(low[left], low[j])
        reach *= 2
        rest = left[nxt[left] >= 0]
        if not most and len(rest) == len(left):  # nothing was resolved: cycles
            most = int(np.bincount(g[left]).max())
        left = rest
    in_cycle = np.zeros(n, bool)
    in_cycle[left] = True
    cycle = np.zeros(n, np.uint64)
    cycle[left] = low[nxt[left]]
    out = {"th": th, "tl": tl, "s": s, "root": s[top], "depth": depth.astype(np.int32), "orphan": has_p[top] & ~in_cycle, "cycle": cycle.view(np.int64), "in_cycle": in_cycle, "n_below": size - 1}
    return out | {"seg": seg, "hop": hop} if with_path else out


def _paths(r: dict, a: int, b: int) -> list[str | None]:
    """Paths of the nodes ``a`` to ``b``, from their segments."""
    seg, hop, out = r["seg"], r["hop"], []
    for i, (c, x) in enumerate(zip(r["in_cycle"][a:b].tolist(), hop[a:b].tolist()), a):
        if c:
            out.append(None)
        elif x < 0:
            out.append(seg[i])
        else:
            parts = [seg[i]]
            while x >= 0:
                parts.append(seg[x])
                x = int(hop[x])
            out.append("/".join(reversed(parts)))
    return out


def _to_batches(r: dict, with_path: bool) -> Iterator[pa.RecordBatch]:
    c = r["in_cycle"]
    arrays = [pa.array(r["th"]), pa.array(r["tl"]), pa.array(r["s"]), pa.array(r["root"], mask=c), pa.array(r["depth"], mask=c), pa.array(r["orphan"]), pa.array(r["cycle"], mask=~c), pa.array(r["n_below"], mask=c)]
    names = ["th", "tl", "s", "root", "depth", "orphan", "cycle", "n_below"]
    whole = pa.RecordBatch.from_arrays(arrays, names)
    # rows of 20,000, fewer where their paths are long
    room = np.cumsum(np.where(c, 0, r["depth"].astype(np.int64) + 1) * 17) if with_path else np.zeros(len(c), np.int64)
    a = 0
    while a < len(c):
        b = min(len(c), a + 20_000)
        if with_path:
            b = min(b, max(a + 1, int(np.searchsorted(room, (room[a - 1] if a else 0) + BATCH_BYTES))))
        batch = whole.slice(a, b - a)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_paths(r, a, b), pa.string())], [*names, "path"]) if with_path else batch
        a = b


def _in_task(with_path: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by trace: whole traces are gathered up to CHUNK_ROWS and doubled together."""
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(t: pa.Table):
            col = lambda c, fill=0: t[c].combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False)
            has_p = t["p"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            r = resolve(col("th"), col("tl"), col("s"), col("p"), has_p, col("arrival", -(2**63)), with_path)
            yield from _to_batches(r, with_path)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < CHUNK_ROWS:
                continue
            t = pa.Table.from_batches(held)
            th, tl = t["th"].to_numpy(), t["tl"].to_numpy()
            cuts = np.flatnonzero((th[1:] != th[:-1]) | (tl[1:] != tl[:-1]))
            if len(cuts):
                cut = int(cuts[-1]) + 1
                yield from flush(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                rows = t.num_rows - cut
        if rows:
            yield from flush(pa.Table.from_batches(held))

    return run


def hierarchy(usable: DataFrame, with_path: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per span: ``th, tl, s, root, depth, orphan, cycle, n_below`` and, if asked, ``path`` (ids from the root, ``/`` between).

    ``usable`` has ``th, tl, s, p, arrival``; other columns play no part. Of repeated spans the last arrival counts.
    ``root`` is the farthest existing ancestor and ``orphan`` says that this one names a parent that does not exist.
    Spans on a cycle or below one have ``cycle`` (its smallest id) and null ``root``, ``depth``, ``n_below`` and ``path``.
    Empty input gives no rows."""
    ship(usable.sparkSession)
    rows = usable.select("th", "tl", "s", "p", "arrival")
    sizes = rows.groupBy("th", "tl").count().filter(F.col("count") > task_rows).select("th", "tl")
    large = written(sizes, "large-traces")
    some_large = large.limit(1).count() > 0
    small = rows.join(large, ["th", "tl"], "left_anti") if some_large else rows
    schema = SCHEMA + (", path string" if with_path else "")
    out = small.repartition(partitions_for(rows), "th", "tl").sortWithinPartitions("th", "tl").mapInArrow(_in_task(with_path), schema)
    return out.unionByName(_by_joins(rows.join(large, ["th", "tl"], "left_semi"), with_path)) if some_large else out


def _by_joins(rows: DataFrame, with_path: bool) -> DataFrame:
    """The same recurrence for traces of any size, a distributed join and a written table per round."""
    at = F.coalesce(F.col("arrival"), F.lit(-(2**63)))
    # xor of the sign bit makes signed order agree with the order of canonical ids
    flip = lambda c: c.bitwiseXOR(F.lit(-(2**63)))
    seg = (span_hex(F.col("s")) if with_path else F.lit("")).alias("seg")
    t = written(
        rows.groupBy("th", "tl", "s")
        .agg(F.max_by("p", at).alias("p"))
        .select("th", "tl", "s", F.col("s").alias("top"), F.col("p").alias("next"), F.lit(0).alias("depth"), flip(F.col("s")).alias("low"), F.lit(False).alias("orphan"), F.lit(1).cast("bigint").alias("size"), seg),
        "doubling",
    )
    names = ["top", "next", "depth", "low", "orphan", "seg"]
    key = ["th", "tl", "s"]
    known = t.filter("next is not null").count()
    reach, in_loops = 1, None
    while known:
        o = t.select("th", "tl", F.col("s").alias("next"), F.lit(True).alias("there"), *[F.col(c).alias("o_" + c) for c in names])
        j = t.filter("next is not null").join(o, ["th", "tl", "next"], "left")
        step = j.select(
            *key,
            F.coalesce("o_top", "top").alias("top"),
            F.when(F.col("there"), F.col("o_next")).alias("next"),
            (F.col("depth") + F.coalesce(F.col("o_depth") + 1, F.lit(0))).cast("int").alias("depth"),
            F.least("low", F.coalesce("o_low", "low")).alias("low"),
            F.coalesce("o_orphan", F.lit(True)).alias("orphan"),
            "size",
            (F.when(F.col("there"), F.concat_ws("/", "o_seg", "seg")).otherwise(F.col("seg")) if with_path else F.lit("")).alias("seg"),
        )
        # each node adds what is below it to the node that it jumps to
        up = t.filter("next is not null").groupBy("th", "tl", F.col("next").alias("s")).agg(F.sum("size").alias("more"))
        all_rows = t.filter("next is null").unionByName(step).join(up, key, "left")
        new = written(all_rows.withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more"), "doubling")
        drop_table(t)
        t, before = new, known
        known = t.filter("next is not null").count()
        reach *= 2
        if known == before:
            if in_loops is None:
                per = t.filter("next is not null").groupBy("th", "tl").count().agg(F.max("count")).collect()
                in_loops = int(per[0][0])
            if reach >= in_loops:
                break
    # ``next`` of a node in a loop lies on the cycle by now, and its ``low`` covers that cycle
    null = lambda kind: F.lit(None).cast(kind)
    loops = t.filter("next is not null")
    on = loops.select("th", "tl", F.col("s").alias("next"), flip(F.col("low")).alias("cycle"))
    cyc = loops.join(on, ["th", "tl", "next"]).select(*key, null("bigint").alias("root"), null("int").alias("depth"), F.lit(False).alias("orphan"), "cycle", null("bigint").alias("n_below"), null("string").alias("path"))
    done = t.filter("next is null").select(*key, F.col("top").alias("root"), "depth", "orphan", null("bigint").alias("cycle"), (F.col("size") - 1).alias("n_below"), F.col("seg").alias("path"))
    both = done.unionByName(cyc)
    return both if with_path else both.drop("path")


def cycles(nodes: DataFrame) -> DataFrame:
    """``trace_id, span_id, cycle_span_id`` of every span on a cycle or below one."""
    return nodes.filter("cycle is not null").select(
        trace_hex(F.col("th"), F.col("tl")).alias("trace_id"), span_hex(F.col("s")).alias("span_id"), span_hex(F.col("cycle")).alias("cycle_span_id")
    )


def descendants(nodes: DataFrame) -> DataFrame:
    """``trace_id, ancestor_id, span_id, distance`` for each node and each node below it, from the paths."""
    ids = F.split("path", "/")
    return (
        nodes.filter("path is not null and depth > 0")
        .select(trace_hex(F.col("th"), F.col("tl")).alias("trace_id"), span_hex(F.col("s")).alias("span_id"), F.col("depth"), F.posexplode(F.slice(ids, 1, F.col("depth"))).alias("at", "ancestor_id"))
        .select("trace_id", "ancestor_id", "span_id", (F.col("depth") - F.col("at")).cast("bigint").alias("distance"))
    )
