"""Tree analytics for one trace view: depth, cycles, critical path, timing, recursion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.bytrace import group_starts, over_sorted_groups
from spanloom.operators.fingerprint import parents_of

MAX_DEPTH = 100


def walk(up: list[int], duration: list[int], name: list[str], is_root: list[bool]) -> dict[str, list]:
    """One trace, spans in start order. ``depth``: hops to the farthest ancestor (at most MAX_DEPTH; stops where a cycle closes).
    ``circular``: on a cycle or below one. ``critical``: on the root-to-leaf path with the largest sum of durations, of equal ones the
    first by start; spans deeper than MAX_DEPTH weigh nothing. Where all ancestors run in a circle the path may begin at any span and ends before it would
    meet itself. ``recursive``: the span lies below the last span without a parent, and its name occurs among its ancestors."""
    n = len(up)
    depth, state = [-1] * n, [0] * n
    circular = [False] * n
    roots = [i for i in range(n) if up[i] < 0]
    kids: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(up):
        if p >= 0:
            kids[p].append(i)
    order = list(roots)
    for i in roots:
        depth[i] = 0
    at = 0
    while at < len(order):
        i = order[at]
        at += 1
        for j in kids[i]:
            depth[j] = depth[i] + 1
            order.append(j)
    for i in range(n):
        if depth[i] < 0:  # never reached from a root: its ancestors run in a circle
            circular[i] = True
            seen, x = set(), i
            while x not in seen:
                seen.add(x)
                x = up[x]
            state[i] = len(seen)
    best, via = [0] * n, [-1] * n
    for i in reversed(order):
        if depth[i] > MAX_DEPTH:
            continue
        top = -1
        for j in kids[i]:
            if best[j] > top:
                top, via[i] = best[j], j
        best[i] = max(duration[i], 0) + max(top, 0)
    critical = [False] * n
    start = -1
    for i in roots:
        if start < 0 or best[i] > best[start]:
            start = i
    while start >= 0 and depth[start] <= MAX_DEPTH:
        critical[start] = True
        start = via[start]
    if n and not roots:
        for i in _rootless(kids, duration):
            critical[i] = True
    recursive = [False] * n
    last = max((i for i in range(n) if is_root[i]), default=-1)
    below = [False] * n
    names: list[frozenset] = [frozenset()] * n
    for i in order:
        below[i] = i == last or (up[i] >= 0 and below[up[i]])
        if not below[i]:
            continue
        above = names[up[i]] if up[i] >= 0 else frozenset()
        recursive[i] = name[i] in above
        names[i] = above if recursive[i] else above | {name[i]}
    return {"depth": [min(state[i] if circular[i] else depth[i], MAX_DEPTH) for i in range(n)], "circular": circular, "critical": critical, "recursive": recursive}


def _rootless(kids: list[list[int]], duration: list[int]) -> list[int]:
    """The longest path of a trace without a root, from any of its spans, of equal ones the first. A span has one parent, so a path from a span can only
    meet itself where it began."""
    best_all, path = -1, []
    for start in range(len(kids)):
        order, depth = [start], {start: 0}
        for i in order:
            if depth[i] < MAX_DEPTH:
                for j in kids[i]:
                    if j != start:
                        depth[j] = depth[i] + 1
                        order.append(j)
        best, via = {}, {}
        for i in reversed(order):
            top, via[i] = -1, -1
            for j in kids[i]:
                # a child that would close the circle or lies too deep counts nothing and ends the path
                b = best.get(j, 0) if j != start else 0
                if b > top:
                    top, via[i] = b, j if j != start and j in depth and depth[j] == depth[i] + 1 else -1
            best[i] = max(duration[i], 0) + max(top, 0)
        if best[start] > best_all:
            best_all, path, i = best[start], [], start
            while i >= 0:
                path.append(i)
                i = via[i]
    return path


def tree_view(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, depth, circular, critical, recursive`` for every span of ``valid_spans``."""

    def run(t: pa.Table) -> pa.Table:
        starts = np.r_[group_starts(t, ["trace_id"]), t.num_rows]
        sid, pid, dur, name = (t[c].to_pylist() for c in ("span_id", "parent_id", "duration", "name"))
        out: dict[str, list] = {"depth": [], "circular": [], "critical": [], "recursive": []}
        for a, b in zip(starts, starts[1:]):
            for k, v in walk(parents_of(sid[a:b], pid[a:b]), dur[a:b], name[a:b], [not x for x in pid[a:b]]).items():
                out[k] += v
        return pa.table({"trace_id": t["trace_id"], "span_id": t["span_id"], "depth": pa.array(out["depth"], pa.int32()), **{k: out[k] for k in ("circular", "critical", "recursive")}})

    rows = spans.selectExpr("trace_id", "span_id", "parent_id", "start_time", "duration", "concat_ws(':', service_name, operation_name) as name")
    return over_sorted_groups(rows, ["trace_id"], ["start_time", "span_id"], run, "trace_id string, span_id string, depth int, circular boolean, critical boolean, recursive boolean")


def timing(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, offset_pct, width_pct``: place and width in the trace's bar; a bar without length shares 100 evenly."""
    w = Window.partitionBy("trace_id")
    lo, hi, n = F.min("start_time").over(w), F.max(F.col("start_time") + F.col("duration")).over(w), F.count("*").over(w)
    x = spans.select("trace_id", "span_id", "start_time", "duration", lo.alias("lo"), (hi - lo).alias("total"), n.alias("n"))
    clamp = lambda c, a: F.greatest(F.lit(a), F.least(F.lit(100.0), c))
    some = F.col("total") > 0
    return x.select(
        "trace_id", "span_id",
        F.when(some, clamp((F.col("start_time") - F.col("lo")) * F.lit(100.0) / F.nullif("total", F.lit(0)), 0.0)).otherwise(0.0).alias("offset_pct"),
        F.when(some, clamp(F.col("duration") * F.lit(100.0) / F.nullif("total", F.lit(0)), 0.5)).otherwise(F.lit(100.0) / F.col("n")).alias("width_pct"),
    )


def axis_ticks(spans: DataFrame, ticks: int = 5) -> DataFrame:
    """``trace_id, tick, at_us``: evenly spaced ticks from 0 to the trace's length."""
    total = spans.groupBy("trace_id").agg((F.max(F.col("start_time") + F.col("duration")) - F.min("start_time")).alias("total"))
    return total.select("trace_id", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))).alias("tick"), "total").select(
        "trace_id", "tick", (F.col("total") * F.col("tick") / F.lit(float(ticks - 1))).alias("at_us")
    )
