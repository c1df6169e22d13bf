"""Encoding with a byte-level BPE tokenizer by tree reduction.

An encoding of a piece of text is an element of a monoid: its words (the matches of the tokenizer's splitting pattern; merges never cross them), where
each begins, and the token ids of each. A text is cut into leaves, the leaves are encoded on their own, and neighbours
are joined pairwise up the tree. Joining has to mend the words around the cut only:

- On the left, a word that ends two characters or more before the cut was found by looking at characters left of the cut alone
  (the pattern looks at most one character past the word, or three past its start). It is a word of the joined text too.
- From there the joined text is split anew, word by word, until a word ends where a word of the right part begins. The pattern never looks
  back, so from that place on both splittings, and with them the tokens, are the same.

So the window grows until both sides provably stay as they are, and the result equals the encoding of the whole text. Decoding
concatenates the bytes up the same tree. The vocabulary is read where the job is planned and sent to the tasks.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import ship

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a leaf: nine in ten texts of a few sentences have several.
LEAF = 64
#: Words whose ids a codec keeps.
WORDS = 500_000

# The splitting pattern of byte_bpe_50k, as its vocabulary's README gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same with white space written out: the tokenizer takes Unicode's White_Space, where libraries differ.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WS}\p{{L}}\p{{N}}]").replace(r"(?!\S)", rf"(?![^{_WS}])").replace(r"\s+", rf"[{_WS}]+"))


class Codec:
    """A tokenizer read from a rank file."""

    def __init__(self, vocab: str | bytes = VOCAB, leaf: int = LEAF):
        import tiktoken

        raw = vocab if isinstance(vocab, bytes) else Path(vocab).read_bytes()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf = max(4, leaf)
        self.known: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            got = self.enc.encode_ordinary(word)
            if len(word) <= 32:
                if len(self.known) >= WORDS:
                    self.known.clear()
                self.known[word] = got
        return got

    def _leaf(self, part: str, at: int) -> tuple[list[int], list[list[int]]]:
        """Begins (places in the text, where the part lies ``at``) and ids of the words of a part on its own."""
        begins, ids, word = [], [], self._word
        for m in _SPLIT.finditer(part):
            begins.append(at + m.start())
            ids.append(word(m.group()))
        return begins, ids

    def _join(self, text: str, left: tuple, right: tuple, cut: int, end: int) -> tuple[list[int], list[list[int]]]:
        (lb, li), (rb, ri) = left, right
        k = max(bisect_right(lb, cut - 2) - 1, 0)  # words before lb[k] end two characters before the cut or earlier
        begins, ids = lb[:k], li[:k]
        for m in _SPLIT.finditer(text, lb[k], end):
            begins.append(m.start())
            ids.append(self._word(m.group()))
            if m.end() >= cut:
                j = bisect_left(rb, m.end())
                if j < len(rb) and rb[j] == m.end():
                    return begins + rb[j:], ids + ri[j:]
        return begins, ids

    def encode(self, text: str | None) -> list[int]:
        """Token ids without special tokens; null and empty text give an empty list. Strings of special tokens are ordinary text."""
        if not text:
            return []
        cuts = [*range(0, len(text), self.leaf), len(text)]
        level = [(a, b, self._leaf(text[a:b], a)) for a, b in zip(cuts, cuts[1:])]
        while len(level) > 1:
            up = [(x[0], y[1], self._join(text, x[2], y[2], x[1], y[1])) for x, y in zip(level[::2], level[1::2])]
            level = up + level[len(level) & ~1 :]
        return list(chain.from_iterable(level[0][2][1]))

    def decode(self, ids) -> str:
        """The text of ids, halves decoded to bytes and put together up the tree."""
        ids = list(ids)

        def part(a: int, b: int) -> bytes:
            if b - a <= self.leaf:
                return self.enc.decode_bytes(ids[a:b])
            m = (a + b) // 2
            return part(a, m) + part(m, b)

        return part(0, len(ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(vocab: str | bytes = VOCAB, leaf: int = LEAF) -> Codec:
    """One codec per worker process."""
    return Codec(vocab, leaf)


def encode_texts(docs: DataFrame, vocab: str = VOCAB, leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs`` (``doc_id``, ``text``), repeated rows included.

    Null and empty texts give an empty list; blank ones are tokenized as they are. Other columns play no part."""

    ship(docs.sparkSession)
    # the rank file has one line per token of the vocabulary, under a megabyte; workers need no copy of it
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocab).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, leaf)
        for b in batches:
            ids, held, start = [], 0, 0
            for i, t in enumerate(b.column(1)):
                ids.append(c.encode(t.as_py()))
                held += len(ids[-1])
                if held >= 1 << 20 or i == b.num_rows - 1:  # long texts leave in smaller batches
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(ids)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                    ids, held, start = [], 0, i + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")
