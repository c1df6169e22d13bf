"""Baselines learned trace by trace, and the findings they give.

Learning is a fold over each service's traces in the order (start_us, trace_id): a trace is first checked against what was learned before it,
then learned. The fold reads a sorted stream, so a service's rows are never gathered; its state is bounded by its paths and their sample
rings. A variant is learned once for all its thresholds, which only differ in when they begin to speak and in what is known good. Three of the variants
count alike and keep the same samples, so they are learned together. What is known good and canonical is kept up from trace to trace: a share can only rise
with a path's own traces, so no trace looks through all paths.

A service's state can be saved and taken up again (``snapshots``, and ``saved`` of ``findings`` and ``learned``): later traces are then checked and learned as if
the earlier ones had just gone through.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.config import HOUR_US, MINUTE_US, VARIANTS, Config, parse_combination
from spanloom.session import ship
from spanloom.workdir import partitions_for

PATH_RING, BRANCH_RING, HOUR_SAMPLES = 1000, 100, 200
# Fixed values of the rules.
WINDOW_US = 24 * HOUR_US
HALF_LIFE_S = 24 * 3600.0
RECENT_US, NEW_US = 5 * MINUTE_US, 10 * MINUTE_US
KNOWN_SHARE, CANONICAL_SHARE = 0.01, 0.1
MIN_RECENT = 20


def percentile(ordered: list, p: float):
    """Value of rank int((n - 1) p); 0 if there is none."""
    return ordered[int((len(ordered) - 1) * min(1.0, max(0.0, p)))] if ordered else 0


def weighted_percentile(pairs: list[tuple[int, float]], p: float):
    """Smallest value whose cumulative weight exceeds (W - 1) p, else the largest; 0 if there is none."""
    pairs = sorted(pairs)
    limit, cum = (sum(w for _, w in pairs) - 1) * min(1.0, max(0.0, p)), 0.0
    for x, w in pairs:
        cum += w
        if cum > limit:
            return x
    return pairs[-1][0] if pairs else 0


class Ring:
    """Samples up to a limit, then slot ``i % limit`` is written anew; kept sorted beside."""

    __slots__ = ("limit", "slots", "ordered")

    def __init__(self, limit: int):
        self.limit, self.slots, self.ordered = limit, [], []

    def put(self, x: int, i: int) -> None:
        if len(self.slots) < self.limit:
            self.slots.append(x)
        else:
            k = i % self.limit
            del self.ordered[bisect.bisect_left(self.ordered, self.slots[k])]
            self.slots[k] = x
        bisect.insort(self.ordered, x)


class Stats:
    """Count, sum and extremes with a ring: a path or a branch. ``rule`` is the kind of variant that ages a path."""

    __slots__ = ("n", "total", "low", "high", "ring", "at", "moving", "start")

    def __init__(self, limit: int):
        self.n, self.total, self.low, self.high, self.ring, self.at = 0, 0, 0, 0, Ring(limit), None
        self.moving, self.start = 0, 0

    def dump(self) -> list:
        return [self.n, self.total, self.low, self.high, self.at, self.moving, self.start, self.ring.slots]

    @classmethod
    def restored(cls, limit: int, d: list) -> Stats:
        p = cls(limit)
        p.n, p.total, p.low, p.high, p.at, p.moving, p.start, p.ring.slots = d
        p.ring.ordered = sorted(p.ring.slots)
        return p

    def learn(self, x: int, stamp: int, rule: str = "cumulative") -> None:
        first = self.at is None
        if first:
            self.low = self.high = self.start = x
        if rule == "cumulative":
            # beside it the running sum of ewma, whose count and samples are the same
            self.moving = x if self.n == 0 else int((0.1 * x + 0.9 * self.moving / self.n) * (self.n + 1))
            self.n += 1
            self.total += x
            self.low, self.high = min(self.low, x), max(self.high, x)
        else:
            if rule == "sliding_window" and not first:
                age = stamp - self.at
                if age > WINDOW_US or (age > 0 and self.n > 1):
                    f = 0.5 if age > WINDOW_US else 1.0 - age / WINDOW_US * 0.05
                    self.n, self.total = int(self.n * f), int(self.total * f)
            self.n += 1
            self.total += x
            self.low = x if rule == "sliding_window" and self.low == 0 else min(self.low, x)
            self.high = max(self.high, x)
        self.at = stamp
        self.ring.put(x, self.n)
        if rule == "exponential_decay" and self.n % 100 == 0:
            self.total = int(self.total * 0.95)
            if self.n > 100:
                self.n = int(self.n * 0.95)


def hour_key(us: int) -> str:
    return datetime.fromtimestamp(us // 1_000_000, timezone.utc).strftime("%Y-%m-%d-%H")


@lru_cache(maxsize=4096)
def _comparison(hour: int) -> tuple[int, ...]:
    t = datetime.fromtimestamp(hour * 3600, timezone.utc) - timedelta(days=1)
    t -= timedelta(days={5: 1, 6: 2}.get(t.weekday(), 0))
    base = int(t.timestamp()) // 3600
    return tuple(range(base - 2, base + 3))


class Hours:
    """Hourly counts and samples of one service, dropped once no later trace compares to them."""

    def __init__(self):
        self.buckets: dict[int, dict] = {}

    def learn(self, fp: str, x: int, start: int, trace_id: str) -> None:
        h = start // HOUR_US
        if h not in self.buckets:
            self.buckets = {k: v for k, v in self.buckets.items() if k >= h - 5 * 24}
            self.buckets[h] = {"n": 0, "paths": {}}
        b = self.buckets[h]
        b["n"] += 1
        p = b["paths"].setdefault(fp, {"n": 0, "low": x, "high": x, "s": []})
        p["n"] += 1
        p["low"], p["high"] = min(p["low"], x), max(p["high"], x)
        # beyond the limit the samples with the smallest hashes of their trace stay
        item = (xxhash.xxh64_intdigest(trace_id.encode()), x)
        if len(p["s"]) < HOUR_SAMPLES:
            bisect.insort(p["s"], item)
        elif item < p["s"][-1]:
            p["s"].pop()
            bisect.insort(p["s"], item)

    def share(self, fp: str, start: int) -> float | None:
        """Share of the path in the busiest comparison hour (the earliest of equal ones)."""
        found = [self.buckets[h] for h in _comparison(start // HOUR_US) if h in self.buckets]
        if not found:
            return None
        b = max(found, key=lambda b: b["n"])
        return b["paths"][fp]["n"] / b["n"] if fp in b["paths"] else 0.0

    def path(self, fp: str, start: int) -> tuple[int, int, int, list[tuple[int, float]]] | None:
        """Count, extremes and weighted samples of the path over all comparison hours."""
        got = [self.buckets[h]["paths"][fp] for h in _comparison(start // HOUR_US) if h in self.buckets and fp in self.buckets[h]["paths"]]
        if not got:
            return None
        one = len(got) < 2
        pairs = [(x, 1.0 if one else p["n"] / len(p["s"])) for p in got for _, x in p["s"]]
        return sum(p["n"] for p in got), min(p["low"] for p in got), max(p["high"] for p in got), pairs


def z_score(x: float, ref: float, p25: float, low: int, high: int) -> float:
    """Distance from the reference percentile in robust deviations, of either side; without spread by a quarter of the range, signed."""
    mad = (ref - p25) / 1.35
    if mad == 0:
        return 0.0 if x == ref or high == low else (x - ref) / ((high - low) / 4)
    return abs(0.6745 * (x - ref) / mad)


PLAIN = ("cumulative", "ewma", "same_time_yesterday")


class Variant:
    """What the variants of one kind know of one service. ``names`` maps each variant to its thresholds; ``kind`` ages counts and paths."""

    def __init__(self, kind: str, names: dict[str, list[int]]):
        self.kind, self.names = kind, names
        self.thresholds = sorted({t for ts in names.values() for t in ts})
        self.counts: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.seen: dict[str, int] = {}  # last stamp of each path, in the order of these
        self.live: dict[str, None] = {}  # paths that aging can still lower
        self.expired: set[str] = set()  # unseen for longer than the window: their count is zero
        self.old: dict[str, int] = {}  # last stamps of these
        self.example: dict[str, tuple] = {}
        self.n = 0
        self.top = ""  # most frequent path, of equal ones the first by name
        self.paths: dict[str, Stats] = {}
        self.known: dict[int, set[str]] = {t: set() for t in self.thresholds}
        self.canonical: dict[int, str] = dict.fromkeys(self.thresholds, "")
        self.recent: dict[str, int] = {}
        self.recent_n = 0
        self.recent_from: int | None = None
        self.previous: dict[str, float] = {}

    def learn(self, fp: str, x: int, stamp: int, branches: tuple) -> None:
        n = self.counts.get(fp, 0) + 1
        self.counts[fp] = n
        self.n += 1
        self.first.setdefault(fp, stamp)
        self.example.setdefault(fp, branches)
        if self.kind != "cumulative":
            self._age(fp, stamp)
            n = self.counts[fp]
        elif n > (best := self.counts.get(self.top, 0)) or (n == best and fp < self.top):
            self.top = fp
        if self.recent_from is None:
            self.recent_from = stamp
        if stamp - self.recent_from > RECENT_US:
            if self.recent_n:
                self.previous = {k: v / self.recent_n for k, v in self.recent.items()}
            self.recent, self.recent_n, self.recent_from = {}, 0, stamp
        self.recent[fp] = self.recent.get(fp, 0) + 1
        self.recent_n += 1
        share = self.counts[self.top] / self.n if self.top else 0.0
        for t in self.thresholds:
            if self.n < t:
                break
            if self.n == t:
                self.known[t].update(k for k, v in self.counts.items() if v / self.n > KNOWN_SHARE)
            elif n / self.n > KNOWN_SHARE:
                self.known[t].add(fp)
            if share > CANONICAL_SHARE:
                self.canonical[t] = self.top
        p = self.paths.get(fp)
        if p is None:
            p = self.paths[fp] = Stats(PATH_RING)
        p.learn(x, stamp, self.kind)

    def _age(self, fp: str, stamp: int) -> None:
        sliding, counts = self.kind == "sliding_window", self.counts
        self.live.pop(fp, None)
        if sliding:
            while self.seen:  # the longest unseen first
                k, at = next(iter(self.seen.items()))
                if stamp - at <= WINDOW_US or k == fp:
                    break
                counts[k] = 0
                self.live.pop(k, None)
                self.expired.add(k)
                self.old[k] = self.seen.pop(k)
        for k in list(self.live):
            age = stamp - self.seen[k]
            f = 1.0 - age / WINDOW_US * 0.1 if sliding else math.exp(-math.log(2) / HALF_LIFE_S * (age / 1e6))
            n = counts[k] = int(counts[k] * f)
            if n <= 1:
                del self.live[k]
        counts[fp] += 1  # a second time for this trace: the rule of these variants
        self.live[fp] = None
        self.seen.pop(fp, None)
        self.old.pop(fp, None)
        self.expired.discard(fp)
        self.seen[fp] = stamp
        if sliding and self.n % 100 == 0:
            for k in [k for k in self.expired if stamp - self.old[k] > 2 * WINDOW_US]:
                del counts[k], self.old[k]
                self.expired.discard(k)
                self.first.pop(k, None)
        # others only fall, so the most frequent path is this one or lies among those that aging has not worn down to one
        most = max(counts[k] for k in self.live)
        self.top = min((k for k in self.live if counts[k] == most), default="")

    def shift(self, fp: str) -> tuple[bool, float, float]:
        old = self.previous.get(fp, 0.0)
        if self.recent_n < MIN_RECENT:
            return False, old, 0.0
        new = self.recent.get(fp, 0) / self.recent_n
        if old > 0:
            return abs(new - old) > 0.1 or abs(new - old) / old > 0.5, old, new
        return new > 0.1, old, new

    def deviation(self, fp: str, at: int, t: int, share: float | None, rare: float, branches: tuple, recursive: bool) -> tuple[str, float, str] | None:
        """Type, score and summary of a deviating path; ``share`` replaces the path's own share where it is known."""
        if self.n < t:
            return None
        n = self.counts.get(fp, 0)
        is_new = fp not in self.first or at - self.first[fp] < NEW_US
        if not is_new and n < t:
            return None
        freq = share if share is not None else n / self.n
        if is_new and freq == 0:
            return "new_path", 1.0, "New execution path detected (never seen before)"
        if fp in self.known[t]:
            shifted, old, new = self.shift(fp)
            if shifted and new < old:
                return "frequency_drop", (old - new) / old, f"Path frequency dropped: {old * 100:.1f}% → {new * 100:.1f}%"
            return None
        if freq < rare:
            shifted, old, new = self.shift(fp)
            if shifted and new > old and new > 0.05:
                return "frequency_spike", new - old, f"Rare path spiking: {old * 100:.1f}% → {new * 100:.1f}%"
            if freq < 0.001:
                return "rare_path", 1.0 - freq * 100, diff_summary(branches, self.example.get(self.canonical[t], ()), recursive)
        return None

    def scores(self, fp: str, x: int, at: int, hours: Hours, pct: float) -> list[tuple[str, float]]:
        """Combinations that can judge the duration, with their scores."""
        p = self.paths.get(fp)
        out: list[tuple[str, float]] = []
        own = None
        for name, ts in self.names.items():
            y = hours.path(fp, at) if name == "same_time_yesterday" else None
            merged = mine = None
            for t in ts:
                if y and y[0] >= t:
                    if merged is None:
                        merged = z_score(x, weighted_percentile(y[3], pct), weighted_percentile(y[3], 0.25), y[1], y[2])
                    out.append((f"{name}:{t}", merged))
                elif p is not None and p.n >= t:
                    if own is None:
                        own = percentile(p.ring.ordered, pct), percentile(p.ring.ordered, 0.25)
                    if mine is None:
                        # the extremes of ewma stay at the first value
                        mine = z_score(x, *own, *((p.low, p.high) if name != "ewma" else (0, 0)))
                    out.append((f"{name}:{t}", mine))
        return out

    # saved and loaded as plain lists and maps with text keys

    _PLAIN = ("counts", "first", "seen", "old", "n", "top", "recent", "recent_n", "recent_from", "previous")

    def dump(self) -> dict:
        out = {k: getattr(self, k) for k in self._PLAIN}
        out |= {"live": list(self.live), "expired": sorted(self.expired), "example": {k: [list(x) for x in v] for k, v in self.example.items()}}
        out |= {"known": {str(t): sorted(v) for t, v in self.known.items()}, "canonical": {str(t): v for t, v in self.canonical.items()}}
        return out | {"order": list(self.seen), "paths": {k: p.dump() for k, p in self.paths.items()}}

    def load(self, d: dict) -> None:
        for k in self._PLAIN:
            setattr(self, k, d[k])
        self.seen = {k: d["seen"][k] for k in d["order"]}
        self.live, self.expired = dict.fromkeys(d["live"]), set(d["expired"])
        self.example = {k: tuple(tuple(x) for x in v) for k, v in d["example"].items()}
        # a threshold that was not learned then starts with nothing known
        self.known = {t: set(d["known"].get(str(t), ())) for t in self.thresholds}
        self.canonical = {t: d["canonical"].get(str(t), "") for t in self.thresholds}
        self.paths = {k: Stats.restored(PATH_RING, x) for k, x in d["paths"].items()}


def diff_summary(branches: tuple, canonical: tuple, recursive: bool) -> str:
    """Branches that a path has beyond the canonical one and lacks, sorted."""
    have, want = {k for k, _ in branches}, {k for k, _ in canonical}
    added, missing = sorted(have - want), sorted(want - have)
    out = (f"Added: [{', '.join(added)}]. " if added else "") + (f"Missing: [{', '.join(missing)}]. " if missing else "")
    return (out.strip() or "Rare execution path") + (" [Contains recursive calls]" if recursive else "")


def slow_branches(branches: tuple, known: dict[str, Stats], pct: float) -> list[str]:
    """At most five branches of a trace that were slower than usual, by excess over the median, of equal ones by name."""
    out = []
    for key, x in branches:
        b = known.get(key)
        if b is None or b.n < 10:
            continue
        ref, p25, p50 = (percentile(b.ring.ordered, p) for p in (pct, 0.25, 0.5))
        mad = (ref - p25) / 1.35
        z = abs(0.6745 * (x - ref) / mad) if mad else 0.0 if x == ref else 10.0
        if z > 2.0:
            out.append((-max(0, x - p50), key))
    return [k for _, k in sorted(out)[:5]]


class Service:
    """All variants of one service, fed trace by trace."""

    def __init__(self, combos: list[str], config: Config):
        self.config = config
        wanted = {v: sorted({t for w, t in map(parse_combination, combos) if w == v}) for v in VARIANTS}
        kinds: dict[str, dict[str, list[int]]] = {}
        for v, ts in wanted.items():
            if ts:
                kinds.setdefault("cumulative" if v in PLAIN else v, {})[v] = ts
        self.variants = [Variant(k, names) for k, names in kinds.items()]
        self.hours = Hours()
        self.branches: dict[str, Stats] = {}
        self.clock = 0

    def feed(self, trace_id: str, fp: str, start: int, x: int, branches: tuple, recursive: bool) -> list[tuple]:
        """Findings of a trace (combination, kind, type, score, canonical, summary, slow branches), then learns it."""
        out = []
        config = self.config
        ahead = config.wall_us is not None and start > config.wall_us + RECENT_US
        if not ahead:
            self.clock = max(self.clock, start)  # a late trace is stamped with the latest time seen
        slow = None
        for v in self.variants:
            for name, ts in v.names.items():
                share = self.hours.share(fp, start) if name == "same_time_yesterday" else None
                for t in ts:
                    if d := v.deviation(fp, self.clock, t, share, config.rare_threshold, branches, recursive):
                        out.append((f"{name}:{t}", "deviation", d[0], d[1], v.canonical[t], f"[{d[0]}] {d[2]}", []))
            for combo, z in v.scores(fp, x, start, self.hours, config.baseline_pct):
                if z >= config.anomaly_threshold:
                    if slow is None:
                        slow = slow_branches(branches, self.branches, config.baseline_pct)
                    out.append((combo, "anomaly", "anomaly", z, "", "", slow))
        for v in self.variants:
            v.learn(fp, x, self.clock, branches)
        if not ahead:
            self.hours.learn(fp, x, start, trace_id)
        for key, d in branches:
            b = self.branches.get(key)
            if b is None:
                b = self.branches[key] = Stats(BRANCH_RING)
            b.learn(d, self.clock)
        return out

    def dump(self) -> str:
        """The whole state as JSON."""
        hours = [[h, b["n"], b["paths"]] for h, b in self.hours.buckets.items()]
        return json.dumps({"clock": self.clock, "hours": hours, "branches": {k: b.dump() for k, b in self.branches.items()}, "variants": {v.kind: v.dump() for v in self.variants}})

    def load(self, text: str) -> None:
        d = json.loads(text)
        self.clock = d["clock"]
        self.hours.buckets = {h: {"n": n, "paths": {k: p | {"s": [tuple(x) for x in p["s"]]} for k, p in paths.items()}} for h, n, paths in d["hours"]}
        self.branches = {k: Stats.restored(BRANCH_RING, x) for k, x in d["branches"].items()}
        for v in self.variants:
            if v.kind in d["variants"]:
                v.load(d["variants"][v.kind])


def _streamed(traces: DataFrame, combos: list[str], config: Config, each, schema: str, saved: DataFrame | None = None) -> DataFrame:
    """Sorted stream of each service through ``each(service, key, rows)``; rows of one service may come in several calls. A service in ``saved``
    begins with its state."""
    has_branches = "branches" in traces.columns
    cols = ["service_id", "start_us", "trace_id", "fingerprint", "duration_us"] + (["branches", "recursive"] if has_branches else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service, key = None, None
        out: list[tuple] = []
        names = [x.split()[0] for x in schema.split(", ")]
        types = spark_types(schema)

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)
            out.clear()
            return b

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if row[0] != key:
                    if service is not None:
                        out += each(service, key, None)
                    service, key = Service(combos, config), row[0]
                if row[-1] is not None:
                    service.load(row[-1])
                else:
                    out += each(service, key, row[:-1])
            if len(out) > 5000:
                yield batch()
        if service is not None:
            out += each(service, key, None)
        yield batch()

    ship(traces.sparkSession)
    rows = traces.select(*cols).filter("service_id is not null and fingerprint is not null and start_us is not null and duration_us is not null").withColumn("state", F.lit(None).cast("string"))
    if saved is not None:
        # the state of a service comes before all its traces
        rows = rows.unionByName(saved.select("service_id", F.lit(-(2**63)).alias("start_us"), "state"), allowMissingColumns=True)
    return rows.repartition(partitions_for(rows), "service_id").sortWithinPartitions("service_id", "start_us", "trace_id").mapInArrow(run, schema)


def spark_types(schema: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    return [kinds[x.split(maxsplit=1)[1]] for x in schema.split(", ")]


def _branches(row: tuple) -> tuple[tuple, bool]:
    if len(row) < 7:
        return (), False
    return tuple((x["branch_key"], x["duration_us"]) for x in row[5] or []), bool(row[6])


FINDINGS = "trace_id string, service_id string, fingerprint string, start_us bigint, combination string, kind string, type string, score double, canonical string, summary string, slow_branches array<string>"


def findings(traces: DataFrame, combos: list[str], config: Config = Config(), saved: DataFrame | None = None) -> DataFrame:
    """Every deviation and anomaly of every combination.

    ``traces`` has ``trace_id, service_id, fingerprint, start_us, duration_us`` and, if known, ``branches`` (array of ``branch_key,
    duration_us``) and ``recursive``. Rows with a null among the first five are neither checked nor learned. ``saved`` is what ``snapshots`` gave of
    earlier traces."""

    def each(s: Service, key: str, row: tuple | None) -> list[tuple]:
        if row is None:
            return []
        branches, rec = _branches(row)
        return [(row[2], key, row[3], row[1], *f) for f in s.feed(row[2], row[3], row[1], row[4], branches, rec)]

    return _streamed(traces, combos, config, each, FINDINGS, saved)


SNAPSHOT = "service_id string, state string"


def snapshots(traces: DataFrame, combos: list[str], config: Config = Config(), saved: DataFrame | None = None) -> DataFrame:
    """``service_id, state``: all that was learned of each service, to be saved and taken up again. A state grows with the paths and branches of its
    service and their sample rings, not with its traces."""

    def each(s: Service, key: str, row: tuple | None) -> list[tuple]:
        if row is None:
            return [(key, s.dump())]
        branches, rec = _branches(row)
        s.feed(row[2], row[3], row[1], row[4], branches, rec)
        return []

    return _streamed(traces, combos, config, each, SNAPSHOT, saved)


BEFORE = "trace_id string, service_id string, fingerprint string, n_service bigint, n_path bigint, known_good boolean, canonical string, recent_total bigint, recent_n bigint, previous double"


def before(traces: DataFrame, combo: str, config: Config = Config()) -> DataFrame:
    """What a combination knows when each trace comes: counts, known good, canonical, the recent window and the path's share in the one before."""
    t = parse_combination(combo)[1]

    def each(s: Service, key: str, row: tuple | None) -> list[tuple]:
        if row is None:
            return []
        v, fp = s.variants[0], row[3]
        out = (row[2], key, fp, v.n, v.counts.get(fp, 0), fp in v.known[t], v.canonical[t], v.recent_n, v.recent.get(fp, 0), v.previous.get(fp, 0.0))
        branches, rec = _branches(row)
        s.feed(row[2], fp, row[1], row[4], branches, rec)
        return [out]

    return _streamed(traces, [combo], config, each, BEFORE)


STATE = "service_id string, combination string, fingerprint string, n_service bigint, n bigint, first_seen bigint, path_n bigint, path_sum bigint, path_min bigint, path_max bigint, p50 bigint, p90 bigint, p99 bigint, known_good boolean, is_canonical boolean, recent bigint, previous double"


def learned(traces: DataFrame, combos: list[str], config: Config = Config(), saved: DataFrame | None = None) -> DataFrame:
    """What is known after all traces: one row per service, combination and path."""

    def each(s: Service, key: str, row: tuple | None) -> list[tuple]:
        if row is not None:
            branches, rec = _branches(row)
            s.feed(row[2], row[3], row[1], row[4], branches, rec)
            return []
        out = []
        for v in s.variants:
            for fp, p in v.paths.items():
                q = [percentile(p.ring.ordered, x) for x in (0.5, 0.9, 0.99)]
                for name, ts in v.names.items():
                    stats = (p.n, p.moving, p.start, p.start) if name == "ewma" else (p.n, p.total, p.low, p.high)
                    for t in ts:
                        out.append((key, f"{name}:{t}", fp, v.n, v.counts.get(fp, 0), v.first.get(fp), *stats, *q, fp in v.known[t], v.canonical[t] == fp, v.recent.get(fp, 0), v.previous.get(fp, 0.0)))
        return out

    return _streamed(traces, combos, config, each, STATE, saved)
