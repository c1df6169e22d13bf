"""Messages delivered more than once: exact quotient hash tables.

An identifier of 192 bits (trace and span) is permuted by an invertible mixing of its three words. The high bits of the
permuted number are its quotient: first the shard (one shuffle partition, or a part of one), below it the home slot in that shard's table. The table does
not store them: an entry holds the remainder, all bits below the quotient, and how far from its home slot it lies. Shard, slot and distance give the
quotient back, so the identifier can be rebuilt from an entry, and equal entries mean equal identifiers: there are no false matches. Each identifier
is inserted once; a later copy finds its entry and only updates what is kept beside it.

Tables run twice: before the shuffle as a bounded combiner, so that a message that a third of all rows
repeat leaves each task once, and after it over a whole shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import span_hex, trace_hex
from spanloom.session import ship
from spanloom.workdir import partitions_for, plan_bytes

_U = np.uint64
#: Entries of the combiner before it is emptied into the shuffle.
COMBINER_ENTRIES = 1 << 17
#: Input (as stored) of a shard, which a task holds as a table.
SHARD_BYTES = 32 << 20


def _mix(x: np.ndarray, c: int) -> np.ndarray:
    """A fixed pseudo-random function of a word (multiply and shift)."""
    x = (x + _U(c)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


#: Words changed and read in each of the nine Feistel steps.
_STEPS = tuple((i % 3, (i + 1) % 3, 0xA5A5 + 7 * i) for i in range(9))


def permute(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """One-to-one map of 192-bit identifiers, three words each: every step xors one word with a function of another."""
    w = [a.copy(), b.copy(), c.copy()]
    for to, by, k in _STEPS:
        w[to] ^= _mix(w[by], k)
    return w


def unpermute(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The inverse of ``permute``."""
    w = [a.copy(), b.copy(), c.copy()]
    for to, by, k in reversed(_STEPS):
        w[to] ^= _mix(w[by], k)
    return w


def shard_of(w0: np.ndarray, bits: int) -> np.ndarray:
    """The leading ``bits`` of the quotient."""
    return (w0 >> _U(64 - bits)).astype(np.int32) if bits else np.zeros(len(w0), np.int32)


class QuotientTable:
    """Linear probing over permuted identifiers of one shard. ``shard_bits`` are used up by the shard, the next ``bits`` name the home slot.

    ``first`` holds, per slot, the remainder's part of the first word and, in the bits that the quotient leaves free, the distance from the home slot
    plus one (0: the slot is empty); ``second`` and ``third`` hold the other two words."""

    def __init__(self, bits: int = 12, shard_bits: int = 0):
        self.shard_bits, self.n = shard_bits, 0
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        self.bits = bits
        self.rest = _U(64 - self.shard_bits - bits)  # bits of the first word that belong to the remainder
        self.low = (_U(1) << self.rest) - _U(1)
        self.first, self.second, self.third = (np.zeros(1 << bits, _U) for _ in range(3))
        self.claim = np.zeros(1 << bits, np.int32)

    def _home(self, w0: np.ndarray) -> np.ndarray:
        return ((w0 << _U(self.shard_bits)) >> _U(64 - self.bits)).astype(np.int64)

    def slots(self) -> np.ndarray:
        """The slots that hold an entry."""
        return np.flatnonzero(self.first)

    def identifiers(self, slots: np.ndarray, shard: np.ndarray | int) -> list[np.ndarray]:
        """The permuted identifiers of entries, rebuilt from shard, slot, distance and remainder."""
        distance = (self.first[slots] >> self.rest).astype(np.int64) - 1
        home = ((slots - distance) & ((1 << self.bits) - 1)).astype(_U)
        top = np.asarray(shard).astype(_U) << _U(64 - self.shard_bits) if self.shard_bits else _U(0)
        return [top | (home << self.rest) | (self.first[slots] & self.low), self.second[slots], self.third[slots]]

    def _insert(self, w: list[np.ndarray]) -> np.ndarray | None:
        """Slots of the identifiers; None where an entry would lie too far from home for its distance to be stored."""
        mask = np.int64((1 << self.bits) - 1)
        out = np.full(len(w[0]), -1, np.int64)
        todo, at, distance = np.arange(len(out)), self._home(w[0]), 0
        rem = w[0] & self.low
        while len(todo):
            distance += 1
            if distance >= 1 << min(self.shard_bits + self.bits, 62):
                return None
            entry = rem[todo] | (_U(distance) << self.rest)
            free = self.first[at] == 0
            if free.any():
                # of the rows that want a free slot one gets it; the others look at it again
                f, fs = todo[free], at[free]
                self.claim[fs] = f
                won = self.claim[fs] == f
                i, slot = f[won], fs[won]
                self.first[slot] = entry[free][won]
                self.second[slot], self.third[slot] = w[1][i], w[2][i]
                self.n += len(i)
            same = (self.first[at] == entry) & (self.second[at] == w[1][todo]) & (self.third[at] == w[2][todo])
            out[todo[same]] = at[same]
            todo, at = todo[~same], (at[~same] + 1) & mask
        return out

    def insert(self, w: list[np.ndarray], shard: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray | None]:
        """Slot of each identifier; equal ones, of this call or before, get the same. Where the table had to grow, also the old slots' new ones."""
        moved = None
        need = self.n + len(w[0])
        grow = self.bits
        while need > (1 << grow) // 2:
            grow += 1
        while True:
            if grow != self.bits:
                moved = self._grow(grow, shard, moved)
            if (got := self._insert(w)) is not None:
                return got, moved
            grow = self.bits + 1

    def _grow(self, bits: int, shard: np.ndarray | int, before: np.ndarray | None) -> np.ndarray:
        held = self.slots()
        ids = self.identifiers(held, shard)
        to = np.full(1 << self.bits, -1, np.int64)
        while True:
            self.n = 0
            self._alloc(bits)
            if (got := self._insert(ids)) is not None:
                break
            bits += 1
        to[held] = got
        return to if before is None else np.where(before >= 0, to[before], -1)


class _Copies:
    """A quotient table with, for each identifier, the number of its copies and the last arrival with its row."""

    def __init__(self, shard_bits: int = 0) -> None:
        self.table = QuotientTable(12, shard_bits)
        self._alloc()

    def _alloc(self) -> None:
        size = 1 << self.table.bits
        self.copies, self.arrival, self.row = np.zeros(size, np.int64), np.full(size, -(2**63), np.int64), np.full(size, -1, np.int64)

    def add(self, w: list[np.ndarray], copies: np.ndarray, arrival: np.ndarray, row: np.ndarray, shard: int = 0) -> None:
        e, moved = self.table.insert(w, shard)
        if moved is not None:
            old = self.copies, self.arrival, self.row
            self._alloc()
            kept = np.flatnonzero(moved >= 0)
            for new, x in zip((self.copies, self.arrival, self.row), old):
                new[moved[kept]] = x[kept]
        np.add.at(self.copies, e, copies)
        np.maximum.at(self.arrival, e, arrival)
        # of equal last arrivals the smallest row number wins: tied copies are identical
        best = arrival == self.arrival[e]
        be, br = e[best], row[best]
        order = np.lexsort((-br, be))
        keep = (self.arrival[be[order]] == arrival[best][order])
        self.row[be[order][keep]] = br[order][keep]


_ID = ("th", "tl", "s")


def _words(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).view(_U) for c in _ID]


def _arrival(b: pa.RecordBatch) -> np.ndarray:
    a = b.column(b.schema.get_field_index("arrival"))
    return a.fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def _combine(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Before the shuffle: identifiers are permuted, and the table is emptied at COMBINER_ENTRIES. Adds ``copies``, ``shard`` and the permuted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state, rows = _Copies(), 0

        def emit() -> Iterator[pa.RecordBatch]:
            at = state.table.slots()
            t = pa.Table.from_batches(held).take(pa.array(state.row[at]))
            words = state.table.identifiers(at, 0)
            for c, x in [*zip(_ID, words), ("copies", state.copies[at]), ("shard", shard_of(words[0], bits))]:
                col, i = pa.array(x.view(np.int64) if x.dtype == _U else x), t.schema.get_field_index(c)
                t = t.set_column(i, c, col) if i >= 0 else t.append_column(c, col)
            yield from t.combine_chunks().to_batches(max_chunksize=20_000)

        for b in batches:
            if not b.num_rows:
                continue
            state.add(permute(*_words(b)), np.ones(b.num_rows, np.int64), _arrival(b), np.arange(rows, rows + b.num_rows))
            held.append(b)
            rows += b.num_rows
            if state.table.n >= COMBINER_ENTRIES:
                yield from emit()
                held, state, rows = [], _Copies(), 0
            elif rows > 4 * state.table.n + 100_000:
                held, rows = _let_go(held, state)
        if rows:
            yield from emit()

    return run


def _let_go(held: list[pa.RecordBatch], state: _Copies) -> tuple[list[pa.RecordBatch], int]:
    """Drops the rows of superseded copies."""
    at = state.table.slots()
    kept = pa.Table.from_batches(held).take(pa.array(state.row[at])).combine_chunks().to_batches()
    state.row[at] = np.arange(len(at))
    return kept, len(at)


def _finish(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """After the shuffle: one table per shard; the shards of a task come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state, rows, now = _Copies(bits), 0, -1

        def emit() -> Iterator[pa.RecordBatch]:
            at = state.table.slots()
            t = pa.Table.from_batches(held).take(pa.array(state.row[at]))
            for c, x in [*zip(_ID, unpermute(*state.table.identifiers(at, now))), ("copies", state.copies[at])]:
                t = t.set_column(t.schema.get_field_index(c), c, pa.array(x.view(np.int64)))
            yield from t.drop_columns(["shard"]).combine_chunks().to_batches(max_chunksize=20_000)

        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
            edges = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)] if len(shard) else []
            for i, j in zip(edges, edges[1:]):
                if shard[i] != now:
                    if rows:
                        yield from emit()
                    held, state, rows, now = [], _Copies(bits), 0, int(shard[i])
                b = batch.slice(i, j - i)
                copies = b.column(b.schema.get_field_index("copies")).to_numpy(zero_copy_only=False)
                state.add(_words(b), copies, _arrival(b), np.arange(rows, rows + b.num_rows), now)
                held.append(b)
                rows += b.num_rows
                if rows > 4 * state.table.n + 100_000:
                    held, rows = _let_go(held, state)
        if rows:
            yield from emit()

    return run


def one_copy_each(rows: DataFrame) -> DataFrame:
    """One row per identifier (``th, tl, s``): its copy with the last ``arrival``, all its columns, and ``copies``, how many there were.

    Rows with a null in ``th``, ``tl`` or ``s`` have no identifier and are left out. A null arrival counts as the earliest and stays null.
    Copies tied at the last arrival are taken as identical and one of them is kept. An extra column ``copies`` or ``shard`` is replaced.
    Empty input gives no rows."""
    ship(rows.sparkSession)
    rows = rows.drop("copies", "shard").filter("th is not null and tl is not null and s is not null")
    parts = partitions_for(rows)
    # a shard is a power of two of all identifiers and small enough for a task's memory; a partition holds one shard or several
    bits = max(0, (max(parts, -(-plan_bytes(rows) // SHARD_BYTES)) - 1).bit_length())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    combined = rows.mapInArrow(_combine(bits), f"{fields}, copies bigint, shard int")
    # whole ranges of shards to a partition
    dealt = combined.repartitionById(parts, F.shiftright(F.col("shard").cast("bigint") * F.lit(parts), bits).cast("int"))
    return dealt.sortWithinPartitions("shard").mapInArrow(_finish(bits), f"{fields}, copies bigint")


def repeated(rows: DataFrame) -> DataFrame:
    """``trace_id, span_id, arrival`` of every span with more than one usable row; ``arrival`` is the last."""
    return (
        one_copy_each(rows.select("th", "tl", "s", "arrival"))
        .filter("copies > 1")
        .select(trace_hex(F.col("th"), F.col("tl")).alias("trace_id"), span_hex(F.col("s")).alias("span_id"), "arrival")
    )
