from __future__ import annotations

import random

from strataframe.llm import leakage as L
from strataframe.llm.textnorm import words

RNG = random.Random(5)
VOCAB = [f"w{a}{b}" for a in "abcdefghijk" for b in "lmnopqrstuv"]
INTRO = "Read the passage below and answer with what it says. "


def text(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCAB) for _ in range(n))


ITEMS = [(i, (INTRO if i < 4 else "") + text(80, i) + ".") for i in range(8)]


def matcher():
    shared = L.openings(t for _, t in ITEMS)
    return L.compile_items([(i, L.item_words(t, shared)) for i, t in ITEMS]), shared


def test_shared_instruction_is_found_and_left_out():
    m, shared = matcher()
    assert shared == {tuple(words(INTRO))} and len(m.items[0]) == 80
    assert L.leaks(m, L.words("Well. " + INTRO + " And that was all there was to say about it, today as on other days.")) == []


def test_wu_manber_finds_what_a_plain_search_finds():
    m, _ = matcher()
    rng = random.Random(9)
    for k in range(300):
        i = rng.randrange(8)
        a = rng.randrange(60)
        doc = text(rng.randrange(40), 1000 + k).split() + words(ITEMS[i][1])[a : a + rng.randrange(3, 20)] + text(30, 2000 + k).split()
        ids = [m.vocabulary.get(w, -1) for w in doc]
        plain = {key for key, item in m.items.items() for p in range(len(item) - L.PATTERN + 1) if any(ids[d : d + L.PATTERN] == item[p : p + L.PATTERN] for d in range(len(ids)))}
        assert L.candidates(m, ids) == plain


def test_partial_altered_and_disguised_passages():
    m, _ = matcher()
    own = L.item_words(ITEMS[5][1], set())
    part = own[10:40]
    altered = [w if i % 9 else "changed" for i, w in enumerate(part)]
    look = " ".join(part).replace("a", "а").upper()  # a Cyrillic letter
    marked = "<p>" + "&nbsp;".join(f"<b>{w}</b>" if i % 5 == 0 else w for i, w in enumerate(part)) + "</p>"
    for doc in (" ".join(part), " ".join(altered), look, marked, ",\n\n".join(part), "​".join(f"{w} " for w in part)):
        assert [i for i, _ in L.leaks(m, L.words(text(50, 77) + " " + doc + " " + text(50, 78)))] == [5]
    inserted = part[:14] + ["more"] + part[14:]
    assert [i for i, _ in L.leaks(m, L.words(" ".join(inserted)))] == [5]


def test_too_little_or_out_of_order():
    m, _ = matcher()
    own = L.item_words(ITEMS[6][1], set())
    assert L.leaks(m, L.words(" ".join(own[:15]))) == []  # less than a quarter
    assert L.leaks(m, L.words(" ".join(w for k in range(0, 60, 6) for w in own[k : k + 6] + ["x", "y"]))) == []  # stretches of six
    swapped = own[40:51] + ["x", "y", "z"] + own[:11]
    assert L.leaks(m, L.words(" ".join(swapped))) == []  # only one of the two counts in order
    assert [i for i, _ in L.leaks(m, L.words(" ".join(own[:11] + ["x", "y", "z"] + own[40:51])))] == [6]


def test_query_on_rows(spark):
    docs = spark.createDataFrame([(1, ITEMS[2][1], 0.5), (2, None, 0.5), (3, "", 0.5), (4, "x " * 20000, 0.5), (5, ITEMS[2][1], 0.5), (5, ITEMS[2][1], 0.5), (None, ITEMS[2][1], 0.5)], "doc_id bigint, text string, share double")
    items = spark.createDataFrame([*ITEMS, (99, None), (98, "short one")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in L.leaked(docs, items).distinct().collect()) == [(1, 2), (5, 2)]
    assert L.leaked(docs, items.limit(0)).count() == 0 and L.leaked(docs.limit(0), items).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in ITEMS], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    whole = sorted(map(tuple, L.leaked(docs, items).collect()))
    monkeypatch.setattr(L, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, L.leaked(docs, items).collect())) == whole and [(a, b) for a, b, _ in whole] == [(i, i) for i in range(8)]


def test_blocks_of_items_give_what_one_search_gives(spark, monkeypatch):
    items = spark.createDataFrame([(i, text(30, i)) for i in range(9)], "item_id bigint, text string")
    docs = spark.createDataFrame([(d, text(20, 90) + " " + text(30, d % 11) + "! <b>" + text(20, 91)) for d in range(22)] + [(None, "x"), (99, None), (98, "")], "doc_id bigint, text string")
    found = lambda: sorted(map(tuple, L.leaked(docs, items).collect()))
    whole = found()
    monkeypatch.setattr(L, "BLOCK_WORDS", 60)
    assert found() == whole and len(whole) == 18
