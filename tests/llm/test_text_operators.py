"""Tokenizing, packing and repair of garbled text against brute force."""

import random

import pytest
from tokenizers import Tokenizer

from spanloom.llm import mojibake, packing, treebpe

TEXTS = [
    "", " ", "   \n\n  x", "don't we'll they've I'd 's 'r 're'", "naïve café — “quoted” … 100% of 3.14", "日本語のテキスト、句読点。", "<|endoftext|> is text",
    "a\x85b\x1cc d​e﻿", "x" * 500, " " * 300, "word " * 400, "\n" * 77 + "end", "🙂👨‍👩‍👧 emoji", "Ünï" * 100, "12345678901234567890 " * 30, "'ll" * 50,
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [4, 7, 16, 64, 8192])
def test_tree_equals_whole(plain, leaf):
    c = treebpe.Codec(leaf=leaf)
    rng = random.Random(leaf)
    alphabet = ["a", "b", " ", "  ", "'s", "'", "re", "\n", "1", "é", "日", ".", "\t", "　", "\x85", "!", "A"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(300)]
    for t in texts:
        ids = list(map(int, c.encode(t)))
        assert ids == plain(t), (leaf, t)
        assert c.decode(ids) == t


def test_encode_texts_nulls_and_repeats(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "hi there", 9), (3, "hi there", 9), (4, " ", 9)]
    got = sorted((r.doc_id, list(r.ids)) for r in treebpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect())
    assert [x for x, _ in got] == [1, 2, 3, 3, 4] and got[0][1] == got[1][1] == [] and got[2] == got[3] and len(got[4][1]) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert treebpe.encode_texts(empty).count() == 0 and packing.pack_texts(empty).count() == 0


def test_packing_keeps_every_token(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(800)] + [(900, " ".join(rng.choices(words, k=3000))), (901, None), (902, ""), (903, "alpha"), (903, "alpha")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.pack_texts(df, capacity=256, shard_items=(200, 300)).collect()
    c = treebpe.Codec()
    need = sorted((d, len(c.encode(t))) for d, t in docs)
    have: dict = {}
    room: dict = {}
    for r in rows:
        have.setdefault(r.doc_id, []).append(r.n_tokens)
        room[r.shard, r.container] = room.get((r.shard, r.container), 0) + r.n_tokens
    assert sum(n for _, n in need) == sum(map(sum, have.values())) and set(have) == {d for d, _ in need}
    assert len(have[903]) == 2 and have[901] == [0] and max(room.values()) <= 256
    assert len(have[900]) == -(-dict(need)[900] // 256) and all(len(v) == 1 for d, v in have.items() if d not in (900, 903))
    # all but one container per shard are all but full
    assert sum(room.values()) / (256 * len(room)) > 0.95


def test_retrieval_prefers_shared_words():
    import numpy as np

    docs = [np.array([1, 2, 3, 4] * 5), np.array([9, 8, 7] * 6), np.array([1, 2, 3] * 6), np.array([7, 9] * 5)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=10)
    index = packing.Index(docs, df, 4, 15.0)
    s = index.query(docs[0])
    assert s[2] > 0 == s[1] and s[3] == 0
    rest = index.only(np.array([False, True, True, True])).query(docs[0])
    assert (rest == s[1:]).all()
    at = packing.pack_shard(docs, df, 4, 15.0, capacity=40)
    assert at[0] == at[2] != at[1]


TOPICS = ["apple pear plum cherry", "brick mortar beam tile", "violin cello flute drum", "granite basalt slate chalk"]


def test_alike_texts_meet_in_bounded_shards(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices(TOPICS[i % 4].split(), k=12)) + f" {i}") for i in range(2000)]
    docs += [(5000 + i, "one text that a third of all rows repeat word for word") for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.pack_texts(df, capacity=512, shard_items=(100, 600)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs)
    held: dict = {}
    for r in rows:
        held.setdefault(r.shard, []).append(r.doc_id)
    assert max(map(len, held.values())) <= 800 and len(held) >= 4
    got = packing.recall(df.filter("doc_id < 5000"), packing.F.col("doc_id") % 100 == 0, 10, 512, shard_items=(100, 600)).collect()[0]
    assert got.n_seeds == 20 and got.recall >= 0.9


def test_fill_takes_the_best_that_fit():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(1, 900))
        size, score, room = rng.integers(1, 40, n), rng.integers(0, 30, n).astype(float), int(rng.integers(40, 300))
        taken, left = packing._fill(np.arange(n), score, size, room)
        assert len(set(taken)) == len(taken) and room - size[taken].sum() == left >= 0
        rest = np.setdiff1d(np.arange(n), taken)
        assert not (size[rest] <= left).any()
        # all but the last are the best ranked of those that fitted
        order, want, space = np.lexsort((np.arange(n), -score)).tolist(), [], room
        for i in order:
            if size[i] <= space and len(want) < len(taken) - 1:
                want.append(i)
                space -= size[i]
        assert taken[: len(want)] == want


def _corpus():
    de = "Die Prüfung der Übersicht läuft wieder während der Nacht für ungefähr eine Stunde und schließt das Fenster früh".split()
    fr = "La caméra répète la dernière étape après chaque redémarrage où la température s’élève à la fenêtre".split()
    ru = "Служба поддержки повторяет последний шаг после обновления и никто этого не видит".split()
    ja = ["時計が狂っているので、週末に地方の事務所は新しい設定を見ない。", "誰にも知られずに、更新の後港のカメラは遅く答える。"]
    rng = random.Random(5)
    return [" ".join(rng.choices(w, k=12)) for w in (de, fr, ru) for _ in range(150)] + ja * 75


GARBLES = [("utf-8", "latin_1"), ("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "koi8_r"), ("cp1251", "koi8_r"), ("cp1251", "latin_1"), ("latin_1", "cp850"), ("euc_jp", "cp932")]


def test_repair_round_trips(spark):
    clean = _corpus()
    rng = random.Random(3)
    rows, truth = [(i, t) for i, t in enumerate(clean)], {}
    n = len(rows)
    for true, read in GARBLES:
        for _ in range(4):
            t = rng.choice(clean)
            try:
                bad = t.encode(true).decode(read)
                if rng.random() < 0.3 and true == "utf-8":
                    bad = bad.encode(true).decode(read)
            except UnicodeError:
                continue
            if bad != t:
                truth[n] = t
                rows.append((n, bad))
                n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  "), (n + 3, "plain"), (n + 4, "é"), (n + 5, "lost � here"), (n + 6, "├── log │ ok"), (n + 7, "A & B &amp; C")]
    got = {r.doc_id: r for r in mojibake.repair(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {d for d, r in got.items() if r.garbled}
    assert len(got) == len(rows) and not found & set(range(len(clean)))
    assert found - {n + 5} <= set(truth) and n + 5 in found and len(truth) > 20
    assert len(found & set(truth)) >= 0.9 * len(truth)
    # words of one letter say too little to be mended
    assert sum(got[d].fixed == t for d, t in truth.items()) >= 0.75 * len(truth)
    assert got[n].fixed is None and not got[n + 7].garbled


def test_repair_of_nothing(spark):
    assert mojibake.repair(spark.createDataFrame([], "doc_id long, text string")).count() == 0
