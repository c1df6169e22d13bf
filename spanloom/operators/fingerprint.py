"""Structural fingerprints of traces.

``wl`` is bit-exact: 20 rounds of label refinement with xxh64 (seed 0), which Spark's own hash cannot express; equal structures of a task
are hashed once. ``shape`` is the canonical string of the rooted trees, as an MD5.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from spanloom.operators.assembly import with_signature
from spanloom.operators.bytrace import group_starts, over_sorted_groups

ROUNDS = 20


def wl_hash(signatures: list[str], parents: list[int], rounds: int = ROUNDS) -> str:
    """Fingerprint of one trace: span i has ``signatures[i]`` and the parent at place ``parents[i]`` (-1: none in the trace)."""
    if not signatures:
        return "empty"
    kids: list[list[int]] = [[] for _ in signatures]
    for i, p in enumerate(parents):
        if p >= 0:
            kids[p].append(i)
    digest = xxhash.xxh64_intdigest
    labels = [digest(s.encode()) for s in signatures]
    for _ in range(rounds):
        # a span's own label first, then those of its children by size
        labels = [digest(struct.pack(f"<{1 + len(k)}Q", labels[i], *sorted(labels[j] for j in k))) for i, k in enumerate(kids)]
    return f"{digest(struct.pack(f'<{len(labels)}Q', *sorted(labels))):016x}"


def shape_text(names: list[str], parents: list[int]) -> str:
    """Canonical text of the trees of a trace: name, then the children's texts sorted; roots and orphans sorted too. Cycles do not occur in it."""
    kids: list[list[int]] = [[] for _ in names]
    top = []
    for i, p in enumerate(parents):
        (kids[p] if p >= 0 else top).append(i)
    order, at = list(top), 0
    while at < len(order):
        order += kids[order[at]]
        at += 1
    text = [""] * len(names)
    for i in reversed(order):
        text[i] = names[i] + "(" + "".join(sorted(text[j] for j in kids[i])) + ")"
    return "".join(sorted(text[i] for i in top))


def parents_of(span_ids: list[str], parent_ids: list[str]) -> list[int]:
    at = {s: i for i, s in enumerate(span_ids)}
    return [at.get(p, -1) if p else -1 for p in parent_ids]


def fingerprints(spans: DataFrame) -> DataFrame:
    """``trace_id, fingerprint, shape`` of every trace of ``valid_spans``."""

    def run(t: pa.Table) -> pa.Table:
        starts = np.r_[group_starts(t, ["trace_id"]), t.num_rows]
        sid, pid = t["span_id"].to_pylist(), t["parent_id"].to_pylist()
        sig, name = t["signature"].to_pylist(), t["name"].to_pylist()
        known: dict = {}
        wl, shape = [], []
        for a, b in zip(starts, starts[1:]):
            up = parents_of(sid[a:b], pid[a:b])
            key = (tuple(sig[a:b]), tuple(name[a:b]), tuple(up))
            if key not in known:
                known[key] = wl_hash(sig[a:b], up), hashlib.md5(shape_text(name[a:b], up).encode()).hexdigest()
            wl.append(known[key][0])
            shape.append(known[key][1])
        return pa.table({"trace_id": t["trace_id"].take(pa.array(starts[:-1])), "fingerprint": wl, "shape": shape})

    rows = with_signature(spans).selectExpr("trace_id", "span_id", "parent_id", "start_time", "signature", "concat_ws('|', service_name, operation_name) as name")
    return over_sorted_groups(rows, ["trace_id"], ["start_time", "span_id"], run, "trace_id string, fingerprint string, shape string")
