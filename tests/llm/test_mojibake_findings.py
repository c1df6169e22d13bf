"""Garbled text that an earlier search missed."""

from collections import Counter

from spanloom.llm import mojibake

RU = "Служба поддержки повторяет последний шаг после обновления и никто этого не видит"


def _repairer(texts):
    """A repairer whose model is fitted to the texts without Spark."""
    c = Counter()
    for t in set(texts):
        c.update({p for w in t.split() for x in (w, w.lower()) for p in mojibake.pairs(x)})
    return mojibake.Repairer(mojibake.Model(dict(c), len(set(texts))))


def test_two_single_byte_steps_through_a_dearer_text():
    words = RU.split()
    r = _repairer([" ".join(words[i % 11 :] + words[: i % 11]) + f" {i}" for i in range(300)])
    word = "поддержки"
    mid = word.encode("cp1251").decode("cp1252")
    twice = mid.encode("cp850").decode("mac_roman")
    # no way by one step, and what lies between is no cheaper
    assert word not in {t for t, _ in mojibake._steps(twice)} and r.model.cost(mid) >= r.model.cost(twice)
    best, _, steps, sure = r.word(twice)
    assert sure and best == word and len(steps) == 2
    assert r.word(word) == (word, 0.0, (), False)


JA = ["時計が狂っているので、週末に地方の事務所は新しい設定を見ない。", "誰にも知られずに、更新の後港のカメラは遅く答える。"]


def test_garbled_word_inside_a_run_of_ideographs():
    bad = "café".encode().decode("latin_1")
    # the garbled pairs are frequent enough that they are not implausible by themselves
    texts = [f"{JA[i % 2]} {i}" for i in range(300)] + [f"le café répété {i}" for i in range(300)] + [f"le {bad} {i}" for i in range(12)]
    r = _repairer(texts)
    run = JA[0][:16] + bad + JA[0][16:]
    best, _, _, sure = r.word(run)
    assert sure and best == JA[0][:16] + "café" + JA[0][16:]
    assert not r.word(JA[0])[3] and not r.word(JA[1])[3]


def test_two_garbled_places_of_one_run():
    r = _repairer([f"{JA[i % 2]} {i}" for i in range(300)])
    clean = bad = JA[0] + JA[1]
    for place in ("地方の事務所", "港のカメラ"):
        bad = bad.replace(place, place.encode("cp932").decode("gbk"))
    assert bad != clean and r.word(bad)[0] == clean and r.word(bad)[3]


def test_copies_do_not_make_garbled_text_plausible(spark):
    fr = "la caméra répète la dernière étape après la température".split()
    en = "the backup copy waits for a confirmation shortly before midnight".split()
    rows = [(i, " ".join(w[i % 7 :] + w[: i % 7]) + f" {i}") for i in range(900) for w in [fr if i % 10 == 0 else en]]
    bad = " ".join(fr).encode().decode("latin_1")
    rows += [(1000 + i, bad) for i in range(450)] + [(2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in mojibake.repair(df).collect()}
    assert len(got) == len(rows) and all(got[1000 + i].garbled and got[1000 + i].fixed == " ".join(fr) for i in range(450))
    assert not any(got[i].garbled for i in range(900)) and not got[2000].garbled


def test_letters_that_are_utf8_by_chance_are_no_garble():
    r = _repairer([f"η ομάδα υποστήριξης επαναλαμβάνει το τελευταίο βήμα {i}" for i in range(300)] + ["ΏΡΑΣ ΏΣΠΟΥ"])
    assert not r.word("ΏΡΑΣ")[3] and not r.word("ΏΣΠΟΥ")[3]
    assert r.word("ομάδα".encode().decode("latin_1"))[::3] == ("ομάδα", True)
