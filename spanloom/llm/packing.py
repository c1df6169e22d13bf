"""Filling fixed-capacity containers with texts by lexical retrieval.

Texts become items of at most one capacity in tokens; only a larger text is split, into full pieces and a rest. Items that are alike go to one
shard of bounded size (``regions``), so that an item and its neighbours meet. Each shard holds a BM25 inverted index of its items, over token ids, with
the document frequencies and the mean length of the whole corpus (at most one number per token of the vocabulary: a bounded broadcast). The largest
unused item opens a container; the index returns its unused neighbours, best first, and every one that still fits goes in. Items
without a token in common come last in that order, so a container is closed only when nothing unused in the shard fits any more.

The last place in a container is given by size instead: see ``_fill``. A shard leaves at most one container open for want of items.
``recall`` measures how many of the best neighbours in the whole corpus a seed can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import regions
from spanloom.llm.treebpe import VOCAB, encode_texts
from spanloom.workdir import drop_table, new_path, written

CAPACITY = 2048
#: Items of a shard: small neighbouring leaves are put together up to the first number, none holds more than the second.
SHARD_ITEMS = (8_192, 49_152)
K1, B = 1.2, 0.75


class Index:
    """BM25 over the items of one shard: postings by token, with the weight of each posting."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n_all: int, mean_len: float):
        sizes = np.array([len(d) for d in docs], np.int64)
        vocab = len(df)
        flat = np.concatenate(docs).astype(np.int64) if len(docs) else np.zeros(0, np.int64)
        key = flat * max(1, len(docs)) + np.repeat(np.arange(len(docs)), sizes)
        key, tf = np.unique(key, return_counts=True)  # sorted by token, then item
        token, self.item = key // max(1, len(docs)), key % max(1, len(docs))
        idf = np.log1p((n_all - df[token] + 0.5) / (df[token] + 0.5))
        norm = K1 * (1 - B + B * sizes[self.item] / max(mean_len, 1e-9))
        self.weight = idf * tf * (K1 + 1) / (tf + norm)
        self.start = np.searchsorted(token, np.arange(vocab + 1))
        self.n = len(docs)

    def only(self, kept: np.ndarray) -> Index:
        """The index of the items that a mask keeps, numbered anew in their order."""
        new = object.__new__(Index)
        there = kept[self.item]
        new.item, new.weight = (np.cumsum(kept) - 1)[self.item[there]], self.weight[there]
        new.start = np.r_[0, np.cumsum(there)][self.start]
        new.n = int(kept.sum())
        return new

    def query(self, ids: np.ndarray) -> np.ndarray:
        """Score of every item of the shard for the different tokens of ``ids``."""
        out = np.zeros(self.n)
        for t in np.unique(ids).tolist():
            a, b = self.start[t], self.start[t + 1]
            out[self.item[a:b]] += self.weight[a:b]  # an item occurs once in a posting list
        return out


#: Best ranked items that are put in order at once; the others only where these do not fill the room.
RANKED = 256


def _fill(fits: np.ndarray, score: np.ndarray, size: np.ndarray, room: int) -> tuple[list[int], int]:
    """Items of ``fits`` that go into ``room``, by falling ``score`` (of equal ones the first), each that fits; what room is left.

    Where the next best would leave a gap that no other item fills, the item that fills the room most exactly takes its place."""
    s = size[fits]
    taken: list[int] = []
    upto = np.cumsum(np.bincount(s[s <= room], minlength=room + 1))  # items of at most each size
    order, at = np.zeros(0, np.int64), 0
    if len(fits) > RANKED:
        bound = np.partition(score, len(score) - RANKED)[len(score) - RANKED]
        head = np.flatnonzero(score > bound)
        order = head[np.argsort(-score[head], kind="stable")]
    full = False
    while True:
        if at < len(order) and s[order[at]] > room:  # what does not fit now never will
            more = np.flatnonzero(s[order[at:]] <= room)
            at = at + int(more[0]) if len(more) else len(order)
        if at == len(order):
            if full:
                break
            free = s <= room
            free[taken] = False
            rest = np.flatnonzero(free)  # all ranked after what was ordered before
            order, at, full = rest[np.argsort(-score[rest], kind="stable")], 0, True
            continue
        i = int(order[at])
        left = room - int(s[i])
        # whether another item fits what would be left
        if left and upto[left] <= sum(1 for j in (*taken, i) if s[j] <= left):
            free = s <= room
            free[taken] = False
            fit = np.flatnonzero(free)
            largest = fit[s[fit] == s[fit].max()]
            i = int(largest[np.argmax(score[largest])])
            taken.append(i)
            room -= int(s[i])
            break
        taken.append(i)
        room, at = left, at + 1
    return [int(fits[i]) for i in taken], room


def pack_shard(docs: list[np.ndarray], df: np.ndarray, n_all: int, mean_len: float, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of every item (a list of token ids each). Items without tokens go into container 0."""
    size = np.array([len(d) for d in docs], np.int64)
    out = np.zeros(len(docs), np.int64)
    unused = size > 0
    index, number, ids = None, 0, np.arange(len(docs))  # ids: the items that the index holds
    for seed in np.lexsort((np.arange(len(docs)), -size)):
        if not unused[seed]:
            continue
        unused[seed] = False
        out[seed] = number
        room = capacity - int(size[seed])
        if index is None:
            index = Index(docs, df, n_all, mean_len)
        elif 2 * int(unused[ids].sum()) < len(ids):  # half of it is used up: go on with the rest
            kept = unused[ids]
            index, ids = index.only(kept), ids[kept]
        live = np.flatnonzero(unused[ids] & (size[ids] <= room))
        if len(live):
            got, room = _fill(ids[live], index.query(docs[seed])[live], size, room)
            out[got] = number
            unused[got] = False
        number += 1
    return out


def _items(encoded: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece, ids``: one item per text, or full pieces and a rest where it is larger than a container."""
    cut = F.when(F.size("ids") <= capacity, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / capacity).cast("int")))
    return encoded.select("doc_id", "ids", F.explode(cut).alias("piece")).select("doc_id", "piece", F.slice("ids", F.col("piece") * capacity + 1, capacity).alias("ids"))


class Corpus:
    """The items of a table of texts, written with their shard, and what is known of the whole corpus.

    Runs jobs: encoding, document frequencies (one number per token of the vocabulary goes to the driver), a sample of at most ``regions.SAMPLE`` items for
    the tree, and the items per leaf."""

    def __init__(self, docs: DataFrame, capacity: int = CAPACITY, vocab: str = VOCAB, shard_items: tuple[int, int] = SHARD_ITEMS):
        spark = docs.sparkSession
        items = written(_items(encode_texts(docs, vocab), capacity), "items")
        n, total = items.agg(F.count("*"), F.sum(F.size("ids"))).collect()[0]
        freq = items.select(F.explode(F.array_distinct("ids")).alias("token")).groupBy("token").agg(F.count("*").alias("df")).toPandas()
        df = np.zeros(int(freq["token"].max()) + 1 if len(freq) else 1, np.int64)
        df[freq["token"].to_numpy(np.int64)] = freq["df"].to_numpy(np.int64)
        self.n, self.mean_len = n, (total or 0) / max(1, n)
        self.df = spark.sparkContext.broadcast(df)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        least, most = shard_items
        tree = regions.Tree()
        if n > most:
            share = F.pmod(F.xxhash64("doc_id", "piece", F.lit(1)), F.lit(1 << 30)) < F.lit(int(min(1.0, regions.SAMPLE / n) * (1 << 30)))
            took = items.filter(share & (F.size("ids") > 0)).select("ids").limit(2 * regions.SAMPLE).toArrow()["ids"].combine_chunks()
            tree = regions.fit(regions.vectors(*_flat(took), idf), n, most)
        sent, kind = spark.sparkContext.broadcast((tree, idf)), docs.schema["doc_id"].dataType.simpleString()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, idf = sent.value
            for b in batches:
                for a in range(0, b.num_rows, 2000):
                    part = b.slice(a, 2000)
                    leaf = tree.leaf(regions.vectors(*_flat(part.column(2)), idf)) if tree.kids else np.zeros(part.num_rows, np.int64)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf.astype(np.int32))], ["doc_id", "piece", "ids", "leaf"])

        placed = written(items.mapInArrow(place, f"doc_id {kind}, piece int, ids array<int>, leaf int"), "placed-items")
        drop_table(items)
        counts = np.zeros(tree.leaves, np.int64)
        for leaf, c in placed.groupBy("leaf").count().collect():
            counts[leaf] = c
        first, parts, self.shards = regions.shards(counts, least, most)
        # as many entries as the tree has leaves, at most one per LEAF_ITEMS of the sample
        at = F.col("leaf") + 1
        one, many = (F.element_at(F.array(*[F.lit(int(x)) for x in v]), at) for v in (first, parts))
        shard = one + F.pmod(F.xxhash64("doc_id", "piece"), many)
        #: ``shard, doc_id, piece, ids``
        self.items = placed.select(shard.cast("int").alias("shard"), "doc_id", "piece", "ids")

    def by_shard(self, run, schema: str) -> DataFrame:
        """``run(table)`` over the items of each shard, sorted by ``doc_id, piece``; a shard is one task's."""

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                yield from run(pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("piece", "ascending")]))

        return self.items.repartitionById(self.shards, "shard").mapInArrow(whole, schema)


def _flat(ids) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a list column in one array, and the length of each list."""
    return ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(ids) -> list[np.ndarray]:
    flat, sizes = _flat(ids)
    off = np.r_[0, np.cumsum(sizes)]
    return [flat[a:b] for a, b in zip(off, off[1:])]


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, vocab: str = VOCAB, shard_items: tuple[int, int] = SHARD_ITEMS) -> DataFrame:
    """``shard, container, doc_id, piece, n_tokens``: every text, whole in one container or, if larger than one, in pieces.

    A container is (shard, container). Null and empty texts have no tokens and lie, without taking room, in a shard's container 0.
    Repeated rows are items each. Empty input gives no rows."""
    c = Corpus(docs, capacity, vocab, shard_items)
    df, n, mean_len = c.df, c.n, c.mean_len

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = _lists(t["ids"].combine_chunks())
        at = pack_shard(parts, df.value, n, mean_len, capacity)
        sizes = pa.array(np.array([len(p) for p in parts]), pa.int32())
        cols = [t["shard"], pa.chunked_array([pa.array(at, pa.int32())]), t["doc_id"], t["piece"], pa.chunked_array([sizes])]
        yield from pa.table(cols, ["shard", "container", "doc_id", "piece", "n_tokens"]).combine_chunks().to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return c.by_shard(run, f"shard int, container int, doc_id {kind}, piece int, n_tokens int")


def recall(docs: DataFrame, seeds: Column, k: int = 10, capacity: int = CAPACITY, vocab: str = VOCAB, shard_items: tuple[int, int] = SHARD_ITEMS) -> DataFrame:
    """``n_seeds, n_neighbours, recall``: of the ``k`` best neighbours in the whole corpus of every item that ``seeds`` names (a condition on ``doc_id``),
    the share that lies in the seed's shard. A neighbour as good as the ``k``-th best counts for it; items without a common token are none.

    The seeds are read from a written table in blocks by every shard's task and scored against the whole shard: exact, by brute force."""
    c = Corpus(docs, capacity, vocab, shard_items)
    df, n, mean_len = c.df, c.n, c.mean_len
    path = new_path(docs.sparkSession, "seeds")
    c.items.filter(seeds & (F.size("ids") > 0)).select(F.col("shard").alias("home"), F.xxhash64("doc_id", "piece").alias("seed"), "ids").write.parquet(path)

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        index = Index(_lists(t["ids"].combine_chunks()), df.value, n, mean_len)
        shard = t["shard"][0].as_py()
        own = t.select(["key"])["key"].to_numpy()
        fs, root = pafs.FileSystem.from_uri(path)
        for block in ds.dataset(root, filesystem=fs, format="parquet").to_batches(batch_size=512):
            out: list[tuple] = []
            for home, seed, ids in zip(block.column("home").to_pylist(), block.column("seed").to_pylist(), _lists(block.column("ids"))):
                s = index.query(ids)
                s[own == seed] = 0.0
                best = np.sort(s[s > 0])[::-1][:k]
                out += [(seed, home == shard, float(x)) for x in best]
            if out:
                a, b, x = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b), pa.array(np.round(x, 9))], ["seed", "near", "score"])

    c.items = c.items.withColumn("key", F.xxhash64("doc_id", "piece"))
    found = c.by_shard(run, "seed bigint, near boolean, score double")
    w = Window.partitionBy("seed").orderBy(F.desc("score"), F.desc("near"))
    top = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.agg(F.countDistinct("seed").alias("n_seeds"), F.count("*").alias("n_neighbours"), F.round(F.avg(F.col("near").cast("double")), 4).alias("recall"))
