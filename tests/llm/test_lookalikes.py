import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import lookalikes as L

_HIDDEN = {c for a, b in L.INVISIBLE for c in range(a, min(b, 0xE0FFF) + 1)}


def plain(text):
    """The form by library calls, one character at a time."""
    out = []
    for c in text:
        if ord(c) in _HIDDEN:
            continue
        form = unicodedata.decomposition(c)
        if form.startswith(("<wide>", "<narrow>")):
            c = chr(int(form.split()[1], 16))
            if ord(c) in _HIDDEN:
                continue
        if L.ROMAN[0] <= ord(c) < L.ROMAN[1]:
            c = unicodedata.normalize("NFKD", c)
        out.append(" " if len(c) == 1 and unicodedata.category(c) == "Zs" and c != " " else "".join(L.SAME_SHAPE.get(x, x) for x in unicodedata.normalize("NFD", c)))
    return unicodedata.normalize("NFC", "".join(out))


letters = st.text(st.sampled_from("aeouEIO іеоАТνΟόїй éüñ ṣ̨̧́́̈​­﻿ 　ｅＡ１．²Ⅳ각각ｶﾞ\n\t-!"), max_size=25)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), letters), max_size=8))
def test_form_is_that_of_library_calls(texts):
    got = L.canonical(pa.array(texts, pa.string())).to_pylist()
    assert got == [None if t is None else plain(t) for t in texts]


def test_form_is_stable_and_rows_do_not_run_together():
    texts = ["e", "́a", "сор", "", "​", "x" * 3_000_000 + "é", None, "ｆｕｌｌ　ｗｉｄｔｈ"]
    once = L.canonical(pa.array(texts))
    assert L.canonical(once).equals(once)
    assert once.to_pylist()[:5] == ["e", "́a", "cop", "", ""] and once[5].as_py().endswith("xé") and once[7].as_py() == "full width"


@pytest.mark.parametrize(("a", "b"), [("m2", "m²"), ("Cop", "cop"), ("resume", "résumé"), ("a  b", "a b"), ("a\nb", "a b"), ("l", "I"), ("α", "a"), ("naive!", "naive."), ("ﬁ", "fi")])
def test_what_can_be_seen_stays(a, b):
    x = L.canonical(pa.array([a, b])).to_pylist()
    assert x[0] != x[1]


def test_pairs(spark):
    rows = [(1, "café ok"), (2, "café ok"), (3, "café ok"), (4, "саfé ok"), (5, "CAFÉ ok"), (6, None), (7, ""), (8, "​"), (9, "alone é"), (10, "alone é"), (11, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, form string")
    got = {tuple(r) for r in L.same_looking(df).collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)}
    assert L.same_looking(df.limit(0)).count() == 0


def test_classes_and_many_disguises_of_one_form(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIRED_AT_ONCE", 3)
    texts = ["".join(r) for r in __import__("itertools").product("oо", "aа", "eе", "pр")]  # 16 texts of one form
    rows = [(i, t) for i, t in enumerate(texts + texts[:2])] + [(99, "other"), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and a < 90 and b < 90 and x != y}
    got = [tuple(r) for r in L.same_looking(df).collect()]
    assert set(got) == want and len(got) == len(want)
    classes = {r.doc_id: (r.class_id, r.n_exact, r.n_links) for r in L.looks(df).collect()}
    assert classes[99] == (99, 1, 0) and classes[0] == (0, 2, 16) == classes[16] and classes[5] == (0, 1, 17) and 100 not in classes


@pytest.mark.parametrize(("text", "plain_text"), [("ⲟꓑᴏɑ", "opoa".replace("p", "P")), ("Ⅻ ⅳ Ⅰ", "XII iv I"), ("ꓮꓐꓚ Ⲭ", "ABC X"), ("ꮃ Ꮍ", "ꮃ Y")])
def test_letters_that_no_table_has(text, plain_text):
    assert L.canonical(pa.array([text])).to_pylist() == [plain_text]


def test_hot_copies_meet_only_the_disguise(spark):
    rows = [(i, "same text é") for i in range(400)] + [(1000, "same text é")]
    got = L.same_looking(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 400
