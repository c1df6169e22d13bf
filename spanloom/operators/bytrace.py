"""Running array code over whole groups without gathering a group's rows in one frame per call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanloom.session import ship
from spanloom.workdir import partitions_for


def over_sorted_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str, chunk_rows: int = 100_000) -> DataFrame:
    """Shuffles by ``keys``, sorts by keys and ``order`` and calls ``fn`` on runs of whole groups of at least ``chunk_rows`` rows.

    One call sees many groups, so that ``fn`` can work on arrays; a group is never split. Empty input gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            r = fn(t)
            if r is not None:
                yield from r.combine_chunks().to_batches(max_chunksize=20_000)

        for b in batches:
            if not b.num_rows:
                continue
            # only the new batch is looked at: what is held is not gone through again for a group that fills many batches
            both = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b] if held else [b])
            new = group_starts(both, keys)
            cut = int(new[-1]) - (1 if held else 0)
            if rows + b.num_rows >= chunk_rows and cut >= 0 and (rows + cut):
                yield from out(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held, rows = [b.slice(cut)], b.num_rows - cut
            else:
                held.append(b)
                rows += b.num_rows
        if rows:
            yield from out(pa.Table.from_batches(held))

    ship(df.sparkSession)
    return df.repartition(partitions_for(df), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where a new group begins in a table sorted by ``keys``."""
    new = np.zeros(t.num_rows, bool)
    if t.num_rows:
        new[0] = True
    for k in keys:
        c = t[k].combine_chunks()
        if t.num_rows > 1:
            a, b = c.slice(0, len(c) - 1), c.slice(1)
            differ = pc.fill_null(pc.not_equal(a, b), True)
            both_null = pc.and_(pc.is_null(a), pc.is_null(b))
            new[1:] |= pc.and_(differ, pc.invert(both_null)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)
