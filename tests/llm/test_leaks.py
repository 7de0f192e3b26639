import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import leaks as L

W = "the a red crown counts nine silver doors before noon while every keeper sleeps".split()
r = random.Random(3)
ITEMS = [" ".join(r.choice(W) for _ in range(n)).capitalize() + "." for n in (11, 12, 13, 40, 60, 12)]
ITEMS.append(ITEMS[3][:150].rpartition(" ")[0])


def found(texts, items):
    a, b = L.find(L.Patterns(list(enumerate(items))), pa.array(texts, pa.string()))
    return set(zip(a.tolist(), b.tolist()))


DISGUISES = [
    lambda t: t, str.upper, lambda t: t.replace(" ", "\n> "), lambda t: t.replace(" ", "  \t"), lambda t: t.replace("e", "е").replace("o", "ο"), lambda t: "​".join(t), lambda t: "*" + t.replace(" ", "* *") + "*", lambda t: t.replace(" ", "_"),
    lambda t: "<b>" + t.replace(" ", "</b> <i class='x'>"), lambda t: t.replace(" ", ", "), lambda t: t.replace(" ", "\\n"), lambda t: t.replace(" ", "&nbsp;"), lambda t: t.replace("oo", "o-\no"), lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t),
]


def test_disguises_are_seen_through():
    texts = [f"Intro words. {d(ITEMS[3])} And more." for d in DISGUISES]
    got = found(texts, ITEMS)
    assert {d for d, i in got if i == 3} == set(range(len(DISGUISES)))


def test_eleven_words_are_not_enough_and_breaks_count():
    w = ITEMS[4].split()
    texts = [" ".join(w[5:16]), " ".join(w[5:17]), " ".join([*w[5:16], "gravel", *w[16:27]]), "", None, " ".join(w[5:11]) + " " + " ".join(w[12:18]), "x" * 100_000 + " " + " ".join(w[20:32])]
    got = {d for d, i in found(texts, ITEMS) if i == 4}
    assert got == {1, 6}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 40), st.integers(0, 30)), max_size=5), max_size=6))
def test_same_as_plain_search(plans):
    texts = [" filler ".join(" ".join(ITEMS[i].split()[a : a + n]) for i, a, n in plan) for plan in plans]
    assert found(texts, ITEMS) == L.brute_force(texts, ITEMS)


def test_long_texts_are_cut_into_lanes_without_loss():
    w = ITEMS[3].split()[:12]
    for at in (0, 400, 490, 501, 505, 512, 1003, 2600):
        text = " ".join(["the"] * at + w + ["crown"] * 700)
        assert (0, 3) in found([text], ITEMS)


def test_operator(spark):
    docs = spark.createDataFrame([(1, ITEMS[3], 9), (2, None, 9), (3, "", 9), (4, ITEMS[3] + " " + ITEMS[3], 9), (4, ITEMS[3], 9), (None, ITEMS[1], 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(i, t, "s") for i, t in enumerate(ITEMS)] + [(99, None, "s"), (100, "", "s")], "item_id long, text string, suite string")
    got = {tuple(x) for x in L.leaked(docs, items).collect()}
    assert {(d, i) for d, i in got if i == 3} == {(1, 3), (4, 3)} and (None, 1) in got
    assert L.leaked(docs.limit(0), items).count() == 0 and L.leaked(docs, items.limit(0)).count() == 0


def test_long_tags_and_entities_are_mark_up_and_prose_between_signs_is_not():
    w = ITEMS[4].split()
    link = "<a class=x href='https://a.example/" + "path/of/many/words-" * 12 + "'>"
    between = lambda x: " ".join(w[5:11]) + " " + x + " " + " ".join(w[11:17])
    texts = [between(link), between("&CounterClockwiseContourIntegral;"), "if a <b then " + "more words " * 12 + " ".join(w[5:17]) + " > c", f"<img title='{' '.join(w[5:17])} {'more words ' * 12}'>", link + " ".join(w[5:16])]
    assert {d for d, i in found(texts, ITEMS) if i == 4} == {0, 1, 2, 3}


def test_capitals_of_other_alphabets_are_read_both_ways():
    item = "встреча назначена на вторник утром в новом здании возле большого старого вокзала города"
    greek = "η συνάντηση έχει οριστεί για την τρίτη το πρωί στο νέο κτίριο κοντά στον σταθμό"
    latin = "before the beacon hall every brown bear kept her own warm hat near nobody"
    texts = [item.upper(), greek.upper(), item.capitalize(), latin.upper().replace("B", "В").replace("H", "Н"), latin.replace("beacon", "Вeacon")]
    assert found(texts, [item, greek, latin]) == {(0, 0), (1, 1), (2, 0), (3, 2), (4, 2)}


def test_items_are_searched_in_sets(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j) % 97}x{i}" for j in range(15)) for i in range(20)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)] + [(50, None)], "doc_id long, text string")
    items = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "item_id long, text string")
    monkeypatch.setattr(L, "ITEM_CHARS", 300)
    assert sorted(map(tuple, L.leaked(docs, items).collect())) == [(i, 100 + i) for i in range(20)]
