"""Shards of texts that are alike: a tree of directions fitted on a bounded sample.

A text is a vector of its tokens, hashed to ``DIM`` places with a sign, weighted by the rarity of each token in the whole corpus. The
sample is halved again and again by two means until no leaf stands for more than ``most`` items of the corpus or the sample gives no more.
Every item goes down the tree to its leaf; leaves are counted over all items, neighbouring small ones are put together up to ``least``, and one that
is larger than ``most`` all the same (copies of one text) is dealt out evenly by a hash: any part of a group of copies serves as well as another.
"""

from __future__ import annotations

import numpy as np

DIM = 512
#: Items that the tree is fitted on, at most.
SAMPLE = 20_000
#: Items of the sample in a leaf, at least.
LEAF_ITEMS = 40


def vectors(flat: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of items given by their token ids in one array; items without tokens give zeros."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    key, tf = np.unique(row * np.int64(len(idf)) + flat, return_counts=True)
    row, token = key // len(idf), key % len(idf)
    h = (token.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    at = (h >> np.uint64(40)).astype(np.int64) % DIM
    sign = np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
    out = np.bincount(row * DIM + at, sign * idf[token] * (1 + np.log(tf)), n * DIM).reshape(n, DIM).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Tree:
    """Inner nodes with a direction and a bound; ``kids`` are node numbers, leaves are ``-1 - leaf``."""

    def __init__(self) -> None:
        self.direction: list[np.ndarray] = []
        self.bound: list[float] = []
        self.kids: list[list[int]] = []
        self.leaves = 1

    def leaf(self, v: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        out = np.zeros(len(v), np.int64)
        if not self.kids:
            return out
        todo = [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            right = v[rows] @ self.direction[node] > self.bound[node]
            for kid, part in zip(self.kids[node], (rows[~right], rows[right])):
                if kid < 0:
                    out[part] = -1 - kid
                else:
                    todo.append((kid, part))
        return out


def _halves(v: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """Direction and bound that part ``v`` by two means; None where nothing parts them."""
    a = v[rng.integers(len(v))]
    b = v[int((v @ a).argmin())]
    for _ in range(12):
        d = b - a
        bound = float(d @ (a + b)) / 2
        right = v @ d > bound
        if right.all() or not right.any():
            return None
        a, b = v[~right].mean(0), v[right].mean(0)
    return d, bound


def fit(sample: np.ndarray, n_all: int, most: int, seed: int = 7) -> Tree:
    """The tree over a sample of the vectors of ``n_all`` items."""
    tree, rng = Tree(), np.random.default_rng(seed)
    share = n_all / max(1, len(sample))
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) * share > most and len(rows) >= 2 * LEAF_ITEMS:
            v = sample[rows]
            if (got := _halves(v, rng)) is not None:
                at = len(tree.kids)
                tree.direction.append(got[0])
                tree.bound.append(got[1])
                tree.kids.append([0, 0])
                right = v @ got[0] > got[1]
                tree.kids[at] = [grow(rows[~right]), grow(rows[right])]
                return at
        leaves += 1
        return -leaves

    if len(sample):
        grow(np.arange(len(sample)))
    tree.leaves = max(1, leaves)
    return tree


def shards(counts: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First shard of each leaf, over how many shards it is dealt, and the number of shards, from the items of each leaf in tree order."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if n > most:
            if held:
                shard, held = shard + 1, 0
            parts[i] = -(-n // most)
            first[i] = shard
            shard += int(parts[i])
            continue
        if held and held + n > most or held >= least:
            shard, held = shard + 1, 0
        first[i] = shard
        held += n
    return first, parts, shard + (1 if held else 0) or 1
