"""Top N items of every group by statistics-guided skipping.

Items are clustered by group: ranges of (group, id) become files, so a file holds few groups and a very large group
is spread over several files. In a file the rows of each group are parted by rank into layers: the best ``LAYER`` ones, then four times as many, and so on.
A layer of all groups is cut into row groups, so that what lies deep in a large group never shares a row group with a small one; the footer lists,
besides the statistics of the scores, the groups of each row group. A reader takes the row groups in descending maximum score, keeps the N
best items of every group, and skips those whose maximum lies strictly below the current N-th score of all their groups: no row in
them can enter any list, and equal scores are still read for the tie rule. Each file gives at most N items per group; where a group is spread, these few
are merged by a window. The clustered files can be kept and asked again with another N.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import ship
from spanloom.workdir import new_path, partitions_for, written

ROWS_PER_ROW_GROUP = 4096
#: Rows of a group in its first layer. Any N may be asked; one up to this number finds its items in the first layer.
LAYER = 32
#: Rows that a writer gathers before it closes a file and starts the next one.
ROWS_PER_FILE = 1 << 20
_FILE_SCHEMA = pa.schema([("g", pa.string()), ("id", pa.int64()), ("score", pa.float64())])


def usable(items: DataFrame) -> DataFrame:
    """``g, id, score`` of the items that compete: no null among them, a finite score; a repeated id counts once.

    Rows of one id are taken as repeats of one item. -0.0 counts as 0.0."""
    inf = float("inf")
    ok = items.select("g", F.col("id").cast("bigint").alias("id"), (F.col("score").cast("double") + F.lit(0.0)).alias("score")).filter(
        F.col("g").isNotNull() & F.col("id").isNotNull() & ~F.isnan("score") & (F.col("score") < inf) & (F.col("score") > -inf)
    )
    return ok.groupBy("g", "id").agg(F.max("score").alias("score"))


def layers(rank: np.ndarray) -> np.ndarray:
    """Layer of each rank (from 0) in its group: LAYER ranks, then up to 4, 16, 64 ... times as many."""
    return np.where(rank < LAYER, 0, 1 + np.floor(np.log2(np.maximum(rank, LAYER) / LAYER) / 2)).astype(np.int64)


def _write_file(t: pa.Table, folder: str) -> str:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    t = t.sort_by([("g", "ascending"), ("score", "descending"), ("id", "ascending")])
    names = pc.unique(t["g"])
    code = pc.index_in(t["g"], names).to_numpy()
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    rank = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
    layer = layers(rank)
    order = np.argsort(layer, kind="stable")
    t, code, layer = t.take(pa.array(order)), code[order], layer[order]
    edges = np.r_[np.flatnonzero(np.r_[True, layer[1:] != layer[:-1]]), len(layer)]
    cuts = [(i, min(i + ROWS_PER_ROW_GROUP, int(b))) for a, b in zip(edges, edges[1:]) for i in range(int(a), int(b), ROWS_PER_ROW_GROUP)]
    lists = [np.unique(code[a:b]).tolist() for a, b in cuts]
    meta = base64.b64encode(zlib.compress(json.dumps({"names": names.to_pylist(), "groups": lists}).encode()))
    t = t.replace_schema_metadata({"row_group_groups": meta})
    file = f"{path}/{uuid.uuid4().hex}.parquet"  # a retried task writes anew; only files that are returned count
    with fs.open_output_stream(file) as out, pq.ParquetWriter(out, t.schema, compression="zstd") as w:
        for a, b in cuts:
            w.write_table(t.slice(a, b - a), row_group_size=ROWS_PER_ROW_GROUP)
    return folder + file[len(path) :]


def clustered(items: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Writes the usable items as clustered files; the result is the table of their names (``file``, ``n_rows``)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).cast(_FILE_SCHEMA)
            return pa.RecordBatch.from_pydict({"file": [_write_file(t, folder)], "n_rows": [t.num_rows]})

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= ROWS_PER_FILE:
                yield close()
                held, rows = [], 0
        if rows:
            yield close()

    ship(items.sparkSession)
    rows = usable(items)
    ranged = rows.repartitionByRange(files or partitions_for(rows), "g", "id").sortWithinPartitions("g", "id")
    return written(ranged.mapInArrow(write, "file string, n_rows bigint"), "clustered")


class Best:
    """The N best items so far of each group of one file, by group code."""

    def __init__(self, n: int, groups: int):
        self.n = n
        self.g, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.nth = np.full(groups, -np.inf)  # the N-th score, -inf where there are fewer

    def add(self, g: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        can = score >= self.nth[g]
        g, ids, score = np.concatenate([self.g, g[can]]), np.concatenate([self.id, ids[can]]), np.concatenate([self.score, score[can]])
        order = np.lexsort((ids, -score, g))
        g, ids, score = g[order], ids[order], score[order]
        first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
        keep = rank < self.n
        self.g, self.id, self.score = g[keep], ids[keep], score[keep]
        last = rank[keep] == self.n - 1
        self.nth[self.g[last]] = self.score[last]


def read_file(file: str, n: int) -> tuple[pa.RecordBatch, int, int]:
    """The N best items of every group of a file, how many row groups it has and how many were read."""
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_file(path) as src:
        f = pq.ParquetFile(src)
        meta = json.loads(zlib.decompress(base64.b64decode(f.schema_arrow.metadata[b"row_group_groups"])))
        names = pa.array(meta["names"], pa.string())
        groups = [np.array(x, np.int64) for x in meta["groups"]]
        at = f.schema_arrow.get_field_index("score")
        top = [f.metadata.row_group(i).column(at).statistics.max for i in range(f.num_row_groups)]
        best, read = Best(n, len(names)), 0
        for i in sorted(range(f.num_row_groups), key=lambda i: -top[i]):
            if (top[i] < best.nth[groups[i]]).all():
                continue
            t = f.read_row_group(i)
            read += 1
            best.add(pc.index_in(t["g"], names).to_numpy().astype(np.int64), t["id"].to_numpy(), t["score"].to_numpy())
    out = pa.RecordBatch.from_arrays([names.take(pa.array(best.g)), pa.array(best.id), pa.array(best.score)], ["g", "id", "score"])
    return out, len(top), read


def top_n(files: DataFrame, n: int) -> DataFrame:
    """``g, id, score, rank``: the N highest scores of every group, of equal scores the smaller id first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                yield read_file(file, n)[0]

    per_file = files.select("file").repartition(max(1, files.count())).mapInArrow(read, "g string, id bigint, score double")
    w = Window.partitionBy("g").orderBy(F.desc("score"), "id")
    return per_file.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def skipping(files: DataFrame, n: int) -> DataFrame:
    """``file, n_rows, n_row_groups, n_read``: what the statistics saved."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read_file(x, n)[1:] for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["file", "n_rows", "n_row_groups", "n_read"])

    return files.select("file", "n_rows").mapInArrow(read, "file string, n_rows bigint, n_row_groups bigint, n_read bigint")


def top_of_each(items: DataFrame, n: int) -> DataFrame:
    """``clustered`` into the shared folder, then ``top_n``."""
    return top_n(clustered(items, new_path(items.sparkSession, "topn")), n)
