"""Garbled text from wrong character encodings: best-first search for the text that was meant.

States are texts. A step undoes one wrong decoding: encode the characters with the encoding that they were read in, decode the bytes with
another; or unescape character references. UTF-8 read as something else is undone in every place where the bytes are valid,
so a text garbled in places needs no special case; other pairs act on a word, or in a longer run on each place where implausible pairs lie
together, on two neighbouring places and on all of them, until no place is left to repair. The search takes the
cheapest state first, never visits a state twice, and goes through one dearer text between two cheaper ones. Single-byte steps map
character to character, so all of them, and all chains of two, are priced at once in arrays, and UTF-8 after one; a chain through a dearer text must
save ``DEARER`` more.

Every distinct word of the corpus is searched once: words are made distinct over all texts first, and what the search found is joined back
to the texts that hold the word.

The cost of a text is the sum of the surprise of its character pairs, from the share of the distinct texts of the corpus that hold a pair. Garbled
pairs are rarer and more numerous than what they stand for. A word is garbled if the search reaches one that is cheaper by the ``MARGIN`` of its kind of
step and has no implausible pair itself; savings of words that the same step mends add up. A text is garbled if a word of it is, or where
characters were lost (U+FFFD) or control characters of the C1 range are left. What was lost is not restored.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import ship
from spanloom.workdir import partitions_for, written

# Encodings that text is read in by mistake, and those that it was written in.
SINGLE = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15", "koi8_r", "cp437", "cp850", "cp852", "cp866", "cp737", "mac_roman", "mac_cyrillic")
MULTI = ("gbk", "cp932", "euc_jp", "big5")

#: Bits that a word must save to count as garbled: bytes that are valid UTF-8 hardly come by chance, other steps more easily.
MARGIN = {"utf-8": 5.0, "single": 8.0, "multi": 12.0}
#: A word mended by single-byte steps that saves at least WEAK counts towards TOGETHER with others of the same steps.
WEAK, TOGETHER = 6.0, 12.0
#: Bits that a step must be worth.
STEP_PRICE = 2.0
#: Bits that a chain through a dearer text must save beyond its margin: it is one of some hundred times as many.
DEARER = 8.0
#: Bits that a word must save to follow the steps that mended another word of its text.
LEAST = 2.0
#: Different garbled letters that must agree on a chain of single-byte steps.
LETTERS = 4
#: Plausible characters between two implausible pairs that belong to one place.
APART = 3
#: Most bits of a pair. Pairs so rare that they cost as much as an unseen one need no entry in the model, which bounds it: a pair that is kept
#: occurs in more than one of 2 ** MAX_BITS texts, so there are at most 2 ** MAX_BITS times as many as a text has different pairs on average.
MAX_BITS = 14.0
_C1 = re.compile("[\x80-\x84\x86-\x9f]")


def _chars(enc: str) -> list[str]:
    """Character of each byte; bytes without one keep their number, as common decoders do."""
    return [bytes([i]).decode(enc, "ignore") or chr(i) for i in range(256)]


TO_BYTE = {e: {c: i for i, c in reversed(list(enumerate(_chars(e))))} for e in SINGLE}
#: Characters to a latin-1 text of their bytes; Latin-1 characters that the encoding lacks become U+2603, which is no byte.
_AS_BYTES = {e: dict.fromkeys(range(128, 256), 0x2603) | {ord(c): i for c, i in t.items() if i > 127 or ord(c) > 127} for e, t in TO_BYTE.items()}
_FROM_BYTE = {e: "".join(_chars(e)) for e in SINGLE}
_ANY_SINGLE = frozenset(c for t in TO_BYTE.values() for c in t if ord(c) > 127)
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_DIGITS = str.maketrans("123456789", "000000000")
_WORD = re.compile(r"[^\t-\r ]+")
_HIGH = re.compile("[^\x00-\x7f]")


def pairs(text: str) -> list[str]:
    """Character pairs of a text with a blank before and after; all digits count as one."""
    t = f" {text} ".translate(_DIGITS)
    return [t[i : i + 2] for i in range(len(t) - 1)]


def count_pairs(docs: DataFrame) -> DataFrame:
    """``pair, n``: in how many texts each pair of characters of their words, as written or in lower case, occurs. Over all rows given, combined per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()
        known: dict[str, frozenset[str]] = {}

        def of(word: str) -> frozenset[str]:
            got = known.get(word)
            if got is None:
                got = frozenset(p for x in {word, word.lower()} for p in pairs(x))
                if len(word) <= 24:
                    if len(known) > 100_000:
                        known.clear()
                    known[word] = got
            return got

        def out() -> pa.RecordBatch:
            keys = sorted(c)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([c[k] for k in keys], pa.int64())], ["pair", "n"])

        for b in batches:
            for t in b.column(0):
                if (s := t.as_py()) is not None:
                    c.update(frozenset().union(*map(of, set(_WORD.findall(s)))))
                if len(c) > 500_000:
                    yield out()
                    c.clear()
        if c:
            yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class _Known(dict):
    """Bits of the pairs met so far; a new one is asked of the model."""

    def __init__(self, ask):
        super().__init__()
        self.ask = ask

    def __missing__(self, p: str) -> float:
        self[p] = x = self.ask(p)
        return x


class Model:
    """Surprise in bits of each pair of characters."""

    def __init__(self, counts: dict[str, int], texts: int):
        self.bits = {p: min(MAX_BITS, float(np.log2((texts + 1) / (n + 0.3)))) for p, n in counts.items()}
        self.unseen = min(MAX_BITS, float(np.log2((texts + 1) / 0.3)))
        self.known = _Known(self.pair)
        self._matrix: np.ndarray | None = None

    def pair(self, p: str) -> float:
        """Bits of a pair; capitals count as their lower case, other than after a small letter, where they do not belong."""
        own = self.bits.get(p, self.unseen)
        low = p.lower()
        return own if low == p or p[0].islower() else min(own, self.bits.get(low, self.unseen) + 0.5)

    def each(self, text: str) -> list[float]:
        t = f" {text} ".translate(_DIGITS)
        return list(map(self.known.__getitem__, map(add, t, t[1:])))

    def cost(self, text: str) -> float:
        t = f" {text} ".translate(_DIGITS)
        return sum(map(self.known.__getitem__, map(add, t, t[1:])))

    @cached_property
    def attested(self) -> frozenset[str]:
        """Characters of pairs that are not implausible."""
        return frozenset(c for p, b in self.bits.items() if b < 0.85 * self.unseen for c in p)

    def __reduce__(self):
        return _model, (self.bits, self.unseen)

    def matrix(self) -> np.ndarray:
        """Bits of all pairs of ``_CHARS``, as ``pair`` gives them."""
        if self._matrix is None:
            n = len(_CHARS)
            m = np.full((n, n), self.unseen, np.float32)
            for p, b in self.bits.items():
                if len(p) == 2 and p[0] in _AT and p[1] in _AT:
                    m[_AT[p[0]], _AT[p[1]]] = b
            low = np.array([_AT.get(c.lower(), i) for i, c in enumerate(_CHARS)])
            other = low != np.arange(n)
            small = np.array([c.islower() for c in _CHARS])
            capital = (other[:, None] | other[None, :]) & ~small[:, None]
            self._matrix = np.where(capital, np.minimum(m, m[np.ix_(low, low)] + np.float32(0.5)), m)
        return self._matrix


def _model(bits: dict[str, float], unseen: float) -> Model:
    m = Model({}, 0)
    m.bits, m.unseen = bits, unseen
    return m


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``key, text`` of the distinct texts that are not null; the key is the SHA-256 of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.sha2(text, 256).alias("key"), text.alias("text")).filter("text is not null").distinct()


def fit(texts: DataFrame) -> Model:
    """The model of the distinct texts given, so that copies of a garbled text do not make it plausible.

    Only pairs that cost less than an unseen one go to the driver and the tasks; the others cost the same without an entry."""
    n = texts.count()
    rare = (n + 1) / 2**MAX_BITS - 0.3
    kept = count_pairs(texts).filter(F.col("n") > F.lit(max(0.0, rare))).toPandas()
    return Model(dict(zip(kept["pair"], kept["n"].tolist())), n)


def _as_utf8(word: str, mapped: str) -> str | None:
    """The word with every place whose bytes are valid UTF-8 decoded, or None without one."""
    parts, last = [], 0
    for m in _UTF8.finditer(mapped):
        parts += [word[last : m.start()], m.group().encode("latin_1").decode("utf-8")]
        last = m.end()
    return "".join(parts) + word[last:] if parts else None


def _between_single(step: str) -> bool:
    """Whether a step maps character to character; chains cover what follows those."""
    a, _, b = step.partition(">")
    return a in TO_BYTE and b in TO_BYTE


#: Characters that single-byte steps can meet, blank and ASCII first; the last index stands for none.
_CHARS = [chr(i) for i in range(128)] + sorted(_ANY_SINGLE)
_AT = {c: i for i, c in enumerate(_CHARS)}
_NONE = len(_CHARS)
_PAIRS = [(a, b) for a in SINGLE for b in SINGLE if a != b]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Character that each single-byte step makes of each character, and byte of each character in each encoding (0: none)."""
    byte = np.zeros((len(SINGLE), _NONE + 1), np.uint8)
    for k, e in enumerate(SINGLE):
        for c, i in TO_BYTE[e].items():
            byte[k, _AT[c]] = i
    char = np.array([[_AT.get(c, _NONE) for c in _FROM_BYTE[e]] for e in SINGLE], np.int16)
    char[:, 0] = _NONE
    return np.stack([char[SINGLE.index(b)][byte[SINGLE.index(a)]] for a, b in _PAIRS]), byte


_MAP, _BYTE = _tables()


@lru_cache(maxsize=200_000)
def _steps(word: str) -> tuple[tuple[str, str], ...]:
    """Texts one step away from a word, with the step's name; steps between single-byte encodings are priced in ``Repairer._singles``."""
    out: dict[str, str] = {}
    if "&" in word and (u := html.unescape(word)) != word:
        out[u] = "unescape"
    high = _HIGH.findall(word)
    if not high:
        return tuple(out.items())
    if not _ANY_SINGLE.isdisjoint(high):
        raw = _BYTE[:, [_AT.get(c, _NONE) for c in word]]  # 0: the encoding lacks the character
        has_utf8 = ((raw[:, :-1] >= 0xC2) & (raw[:, :-1] < 0xF5) & (raw[:, 1:] >= 0x80) & (raw[:, 1:] < 0xC0)).any(1)
        whole = (raw != 0).all(1)
        done = set()
        for k, enc in enumerate(SINGLE):
            b = raw[k].tobytes()
            if b in done:  # an encoding before it gave the same bytes
                continue
            done.add(b)
            if has_utf8[k] and (t := _as_utf8(word, b.decode("latin_1"))) is not None:
                out.setdefault(t, f"{enc}>utf-8")
            if whole[k] and len(high) > 1:
                for other in MULTI:
                    try:
                        out.setdefault(b.decode(other), f"{enc}>{other}")
                    except UnicodeDecodeError:
                        pass
    for enc in MULTI:
        try:
            raw = word.replace("\ufffd", "?").encode(enc)
        except UnicodeEncodeError:
            continue
        for other in ("utf-8", *MULTI):
            if other != enc:
                t = raw.decode(other, "replace")
                if t.count("\ufffd") * 3 <= len(t):
                    out.setdefault(t, f"{enc}>{other}")
    out.pop(word, None)
    return tuple(out.items())


def _kind(steps: tuple[str, ...]) -> str:
    ends = {x.partition(">")[2] for x in steps if ">" in x}
    if "utf-8" in ends:
        return "utf-8"
    return "multi" if ends & set(MULTI) or any(x.partition(">")[0] in MULTI for x in steps) else "single"


class Repairer:
    """Searches words; equal words of a task are searched once."""

    def __init__(self, model: Model):
        self.model = model
        self.found: dict[str, tuple[str, float, tuple[str, ...], bool]] = {}
        self.parts: dict[tuple[str, bool], tuple[str, float, tuple[str, ...]]] = {}
        self.least: tuple[np.ndarray, np.ndarray, float, np.ndarray] | None = None

    def _least(self, at: np.ndarray) -> float:
        """No text of the same length with the same ASCII characters costs less."""
        if self.least is None:
            m = self.model.matrix()
            self.least = m[:128, 128:].min(1), m[128:, :128].min(0), float(m[128:, 128:].min()), (m[:128, None, 128:] + m[128:, :128].T[None, :, :]).min(2)
        after, before, both, lone = self.least
        a, b = at[:-1], at[1:]
        h, k = a > 127, b > 127
        out = float(self.model.matrix()[a, b][~h & ~k].sum()) + both * int((h & k).sum())
        single = k[:-1] & ~h[:-1] & ~k[1:]
        out += float(lone[a[:-1][single], b[1:][single]].sum())
        rest_in, rest_out = k & ~h & np.r_[~single, True], h & ~k & np.r_[True, ~single]
        return out + float(after[a[rest_in]].sum()) + float(before[b[rest_out]].sum())

    def _singles(self, text: str, below: float) -> list[tuple[str, str]]:
        """Texts one single-byte step away that cost less than ``below``, with the step's name."""
        t = f" {text} ".translate(_DIGITS)
        at = np.array([_AT.get(c, _NONE) for c in t])
        high = at > 127
        if not high.any() or (at == _NONE).any():
            return []
        letters, place = np.unique(at[high], return_inverse=True)
        to = _MAP[:, letters]
        ok = np.flatnonzero((to != _NONE).all(1))
        m = self.model.matrix()
        near = np.flatnonzero(high[:-1] | high[1:])
        fixed = float(m[at[:-1], at[1:]].sum() - m[at[near], at[near + 1]].sum())
        full = np.broadcast_to(at, (len(ok), len(at))).copy()
        full[:, high] = to[ok][:, place]
        cost = m[full[:, near], full[:, near + 1]].sum(1) + fixed
        out: dict[str, str] = {}
        for i in np.flatnonzero(cost < below + 0.01).tolist():
            got = text.translate({ord(_CHARS[c]): _CHARS[x] for c, x in zip(letters, to[ok[i]])})
            if got != text:
                out.setdefault(got, ">".join(_PAIRS[ok[i]]))
        return list(out.items())

    def _chains(self, text: str, below: float) -> list[tuple[str, tuple[str, ...]]]:
        """The cheapest text two single-byte steps away, where any can cost less than ``below``, and those where UTF-8 follows one."""
        t = f" {text} ".translate(_DIGITS)
        at = np.array([_AT.get(c, _NONE) for c in t])
        if (at == _NONE).any() or not (high := at > 127).any():
            return []
        letters, place = np.unique(at[high], return_inverse=True)
        first = _MAP[:, letters]
        ok = np.flatnonzero((first != _NONE).all(1))
        first, rows = np.unique(first[ok], axis=0, return_index=True)
        if not len(first):
            return []
        names = [">".join(_PAIRS[ok[r]]) for r in rows]
        out = []
        if self._least(at) < below:
            m = self.model.matrix()
            two = _MAP[:, first]  # second step, first text, letter
            which = np.argwhere((two != _NONE).all(2))
            near = np.flatnonzero(high[:-1] | high[1:])
            fixed = float(m[at[:-1], at[1:]].sum() - m[at[near], at[near + 1]].sum())
            best = None
            for part in np.array_split(which, 1 + len(which) * len(near) // 4_000_000):
                to = two[part[:, 0], part[:, 1]]
                col = {int(p): to[:, place[i]] for i, p in enumerate(np.flatnonzero(high))}
                cost = np.zeros(len(part), np.float32)
                for p in near:
                    cost += m[col.get(int(p), at[p]), col.get(int(p) + 1, at[p + 1])]
                if len(cost) and (best is None or cost.min() < best[0]):
                    j = int(cost.argmin())
                    best = float(cost[j]), to[j], part[j]
            if best and best[0] + fixed < below:
                to, (second, row) = best[1], best[2]
                out.append((text.translate({ord(_CHARS[c]): _CHARS[x] for c, x in zip(letters, to)}), (names[row], ">".join(_PAIRS[second]))))
        # UTF-8 after one step: only where a lead byte stands before its continuation bytes
        full = np.broadcast_to(at, (len(first), len(at))).copy()
        full[:, high] = first[:, place]
        raw = _BYTE[:, full]
        more = np.pad((raw >= 0x80) & (raw < 0xC0), ((0, 0), (0, 0), (0, 3)))
        n = raw.shape[2]
        lead = (raw >= 0xC2) & more[..., 1 : n + 1] & ((raw < 0xE0) | (raw < 0xF5) & more[..., 2 : n + 2] & ((raw < 0xF0) | more[..., 3 : n + 3]))
        hit = np.argwhere(lead.any(2))
        seen = set()
        for (e, row), b in zip(hit, map(bytes, raw[hit[:, 0], hit[:, 1]])):
            if b in seen:
                continue
            seen.add(b)
            mid = text.translate({ord(_CHARS[c]): _CHARS[x] for c, x in zip(letters, first[row])})
            got = _as_utf8(mid, mid.translate(_AS_BYTES[SINGLE[e]]))
            if got is not None:
                out.append((got, (names[row], f"{SINGLE[e]}>utf-8")))
        return out

    def _search(self, start: str, deep: bool = False) -> tuple[str, float, tuple[str, ...]]:
        """The cheapest text reached, how much it saves, and the steps that lead there; ``deep``: also through dearer texts. What a chain through a dearer text must save
        beyond its margin is taken off, so that it wins only where it saves that much more than another."""
        cost = self.model.cost
        first = cost(start)
        best, best_cost, best_steps = start, first, ()
        # cost with steps; text; steps; extra price of dearer texts on the way; whether this text is dearer than the one before
        heap: list[tuple[float, str, tuple[str, ...], float, bool]] = [(first, start, (), 0.0, False)]
        seen = {start}

        def push(t: str, steps: tuple[str, ...], extra: float, above: float, dearer: bool) -> None:
            if t not in seen:
                tc = cost(t) + STEP_PRICE * len(steps) + extra
                if tc < above:
                    seen.add(t)
                    heapq.heappush(heap, (tc, t, steps, extra, False))
                elif deep and dearer and not _between_single(steps[-1]):
                    heapq.heappush(heap, (tc, t, steps, extra + DEARER, True))

        while heap:
            c, text, steps, extra, dearer = heapq.heappop(heap)
            if dearer and text in seen:
                continue
            seen.add(text)
            if c < best_cost:
                best, best_cost, best_steps = text, c, steps
            elif c > best_cost and not deep:
                break
            elif c > best_cost and steps and _between_single(steps[-1]):  # what follows is among the chains of the text before
                continue
            above = min(c, best_cost)
            for t, name in _steps(text):
                push(t, (*steps, name), extra, above, not dearer)
            for t, name in self._singles(text, above - STEP_PRICE * (len(steps) + 1) - extra):
                push(t, (*steps, name), extra, above, False)
            if deep and c <= best_cost:
                for t, names in self._chains(text, above - DEARER - STEP_PRICE * (len(steps) + 2) - extra):
                    push(t, (*steps, *names), extra + DEARER, above, False)
        return best, first - best_cost, best_steps

    def _places(self, word: str) -> list[tuple[int, int]]:
        """Where implausible pairs of a longer run lie together, then the spans over neighbouring places and over all of them."""
        odd = [i for i, b in enumerate(self.model.each(word)) if b > 0.75 * self.model.unseen]
        out: list[tuple[int, int]] = []
        for i in odd:
            a, b = max(0, i - 1), min(len(word), i + 1)
            if out and a <= out[-1][1] + APART:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        joined = [(x[0], y[1]) for x, y in zip(out, out[1:])]
        return [*dict.fromkeys([*out, *joined, *([(out[0][0], out[-1][1])] if out else [])])]

    def _part(self, part: str, deep: bool) -> tuple[str, float, tuple[str, ...]]:
        """Search of a part of a run."""
        got = self.parts.get((part, deep))
        if got is None:
            got = self._search(part, deep)
            if len(self.parts) > 500_000:
                self.parts.clear()
            self.parts[part, deep] = got
        return got

    def _in_places(self, word: str) -> tuple[str, float, tuple[str, ...]]:
        """A longer run with its garbled places repaired one after another, what that saves, and the steps that save most."""
        total, most, by = 0.0, 0.0, ()
        while True:
            found = []
            for a, b in self._places(word):
                for x in range(max(0, a - 1), min(len(word), a + 3)):
                    for y in range(max(x + 1, b - 2), min(len(word), b + 1) + 1):
                        if (x, y) != (0, len(word)) and y - x > 1:
                            deep = (x, y) == (a, b)
                            mid, _, steps = self._part(word[x:y], deep)
                            if steps:
                                # characters beside the place, the same before and after
                                left, right = word[max(0, x - 1) : x], word[y : y + 1]
                                gain = self.model.cost(left + word[x:y] + right) - self.model.cost(left + mid + right) - STEP_PRICE * len(steps)
                                if gain > 2 and self._sure(word[x:y], mid, gain, steps, deep, (left, right)):
                                    found.append((-gain, x, y, mid, steps))
            taken: list[tuple[int, int, str]] = []
            for gain, x, y, mid, steps in sorted(found):
                if all(y < p or x > q for p, q, _ in taken):
                    taken.append((x, y, mid))
                    total -= gain
                    if -gain > most:
                        most, by = -gain, steps
            if not taken:
                return word, total, by
            for x, y, mid in sorted(taken, reverse=True):
                word = word[:x] + mid + word[y:]

    def _sure(self, word: str, best: str, saved: float, steps: tuple[str, ...], deep: bool = False, beside: tuple[str, str] = ("", "")) -> bool:
        """Whether a cheaper word tells that the one given is garbled."""
        if not any(">" in x for x in steps) or saved < MARGIN[kind := _kind(steps)]:
            return False
        # nearly any few letters become others by some chain of steps: more must agree on one
        if kind == "single" and len(steps) > 1 and len(set(_HIGH.findall(word))) < LETTERS and (deep or not any(c.isascii() and c.isalpha() for c in word)):
            return False
        if kind == "utf-8" and not any(x.partition(">")[0] in MULTI for x in steps):
            # letters alone may be a word that is valid UTF-8 by chance: what comes out must be made of characters of the corpus
            return not word.isalpha() or all(c.isascii() or c in self.model.attested for c in best)
        kind = "multi" if kind == "utf-8" else kind
        return self._plausible(word, best, kind, len(steps), beside)

    def _plausible(self, word: str, best: str, kind: str, steps: int = 1, beside: tuple[str, str] = ("", "")) -> bool:
        if kind == "single":
            # a lone sign tells nothing; a unit of one letter and a sign does, by one step
            if sum(c.isalpha() for c in best) < 2 and not (steps == 1 and any(c.isascii() and c.isalpha() for c in word)):
                return False
            # a sign after a word is no letter of it
            if len(word) == len(best) and word[:-1] == best[:-1] and unicodedata.category(word[-1])[0] in "PS" and best[-1].isalpha():
                return False
        left, right = beside
        odd = [b >= 0.85 * self.model.unseen for b in self.model.each(left + best + right)][bool(left) : -1 if right else None]
        if kind == "multi":
            if len(_HIGH.findall(word)) < 2 or len(word) < 3:
                return False
            return sum(odd) <= 0.1 * len(odd) and ("\ufffd" in word or "\ufffd" not in best)
        return not any(odd)

    def word(self, word: str) -> tuple[str, float, tuple[str, ...], bool]:
        """Repaired word, bits saved, steps, garbled or not."""
        got = self.found.get(word)
        if got is None:
            best, saved, steps = self._search(word)
            sure = self._sure(word, best, saved, steps)
            # a word mended to one without an implausible pair needs no dearer way and has no place left to repair
            done = sure and not self._places(best)
            if not done:
                through = self._search(word, deep=True)
                if through[1] > saved and self._sure(word, *through, deep=True):
                    best, saved, steps, sure = *through, True
                    done = not self._places(best)
            if len(word) > 12 and not done:
                whole, gain, by = self._in_places(word)
                if by and gain > saved + 2:
                    best, saved, steps, sure = whole, gain, by, True
            got = (best, saved, steps, sure)
            if len(self.found) > 200_000:
                self.found.clear()
            self.found[word] = got
        return got

    def text(self, text: str | None) -> tuple[str | None, bool, bool]:
        """Repaired text, whether it was garbled, and whether nothing of it stayed lost."""
        if not text or not (_HIGH.search(text) or "&" in text):
            return text, False, True
        return repaired(self, text, {w: self.word(w) for w in suspicious(text)})


def suspicious(text: str) -> set[str]:
    """Words of a text that can be garbled: those with non-ASCII characters or ``&``."""
    return {w for w in _WORD.findall(text) if not w.isascii() or "&" in w}


def repaired(judge: Repairer, text: str, found: dict[str, tuple[str, float, tuple[str, ...], bool]]) -> tuple[str, bool, bool]:
    """As ``Repairer.text``, with what the search found for the words of the text; words not in ``found`` stay as they are."""
    words = [(m.start(), m.end(), *found[m.group()]) for m in _WORD.finditer(text) if m.group() in found]
    weak: dict[tuple[str, ...], dict[str, float]] = {}
    for a, b, best, saved, steps, sure in words:
        if not sure and saved >= WEAK and _kind(steps) == "single" and any(">" in x for x in steps) and judge._plausible(text[a:b], best, "single", len(steps)):
            weak.setdefault(steps, {})[text[a:b]] = saved
    joint = {k for k, w in weak.items() if len(w) > 1 and sum(w.values()) >= TOGETHER}
    # words too short to tell by themselves follow the steps that mended others of the text
    agreed = {steps for *_, steps, sure in words if sure}
    garbled, out, last = False, [], 0
    for a, b, best, saved, steps, sure in words:
        if sure or (steps in joint and text[a:b] in weak[steps]) or (steps in agreed and saved > LEAST):
            garbled = True
            out += [text[last:a], best]
            last = b
    fixed = "".join(out) + text[last:] if out else text
    lost = "\ufffd" in fixed or bool(_C1.search(fixed))
    return fixed, garbled or lost or "\ufffd" in text, not lost


_FOUND = "word string, best string, saved double, steps array<string>, sure boolean"


def search_words(texts: DataFrame, model: Model) -> DataFrame:
    """``word, best, saved, steps, sure`` of the words of ``texts`` for which a cheaper text was found, each distinct word searched once."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Repairer(sent.value)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                rows = []
                for w in b.column(0).slice(a, 500).to_pylist():
                    best, saved, steps, sure = r.word(w)
                    if steps and (sure or saved > LEAST):
                        rows.append((w, best, saved, list(steps), sure))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()))], ["word", "best", "saved", "steps", "sure"])

    words = texts.select(F.explode(words_of(F.col("text"))).alias("word")).distinct()
    # long runs cost most and lie beside each other in no order: a hash deals them evenly
    return words.repartition(max(partitions_for(texts, 1 << 20), 4 * texts.sparkSession.sparkContext.defaultParallelism), "word").mapInArrow(run, _FOUND)


def words_of(text: Column) -> Column:
    """The different suspicious words of a text, as an array."""
    return F.array_distinct(F.filter(F.split(text, "[\t-\r ]+"), lambda w: w.rlike("[^\\x00-\\x7f]|&")))


def repair(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, garbled, restored, fixed`` of every row: whether its text is garbled, whether that was fully undone, and the repaired text.

    Null, empty, blank and ASCII texts are not garbled; a text that is not garbled is returned as it is. Other columns play no part; repeated rows
    come out as often as they are given. Runs jobs: the distinct texts and what was found for their words are written."""
    ship(docs.sparkSession)
    texts = written(distinct_texts(docs), "texts")
    model = model or fit(texts)
    found = written(search_words(texts, model), "found-words")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # only texts with a word for which something was found, or with lost characters, can be garbled
    held = texts.filter(F.col("text").rlike("[^\\x00-\\x7f]|&")).select("key", F.explode(words_of(F.col("text"))).alias("word"))
    per_text = held.join(found, "word").groupBy("key").agg(F.collect_list(F.struct("word", "best", "saved", "steps", "sure")).alias("found"))
    lost = F.col("text").rlike("[\\x{FFFD}\\x80-\\x84\\x86-\\x9f]")
    todo = texts.join(per_text, "key", "left").filter(lost | F.col("found").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Repairer(sent.value)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                got = []
                for text, words in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    got.append(repaired(judge, text, {x["word"]: (x["best"], x["saved"], tuple(x["steps"]), x["sure"]) for x in words or ()}))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _, _ in got], pa.string()), pa.array([g for _, g, _ in got], pa.bool_()), pa.array([w for _, _, w in got], pa.bool_())],
                    ["key", "fixed", "garbled", "whole"],
                )

    judged = todo.select("key", "text", "found").mapInArrow(run, "key string, fixed string, garbled boolean, whole boolean")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", F.sha2("text", 256))
    garbled = F.coalesce("garbled", F.lit(False))
    return rows.join(judged, "key", "left").select("doc_id", garbled.alias("garbled"), (garbled & F.coalesce("whole", F.lit(True))).alias("restored"), F.coalesce("fixed", "text").alias("fixed"))
