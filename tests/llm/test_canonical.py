"""Problem 1: consistent characters."""

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from coursemill.llm import canonical as c

MARKS = st.lists(st.sampled_from("aeoéüņ̣̃̀́̈x 电Ａ３ⅣΩ⼀аο​­"), max_size=12).map("".join)


@given(MARKS)
def test_is_stable_and_composed(text):
    once = c.canonical_string(text)
    assert c.canonical_string(once) == once
    assert unicodedata.normalize("NFC", once) == once


@given(st.text("abcéüņ̣̃̀́̈", max_size=12))
def test_marks_as_in_normal_form_c(text):
    assert c.canonical_string(text) == unicodedata.normalize("NFC", text)


@pytest.mark.parametrize(("a", "b"), [("３.３ V", "3.3 V"), ("а​b", "ab"), ("µΩ", "μΩ"), ("5 ℃", "5 °C"), ("⼀⻓", "一长"), ("Αd‑b", "Ad-b"), ("é", "é"), ("a b c", "a b c")])
def test_look_the_same(a, b):
    assert c.canonical_string(a) == c.canonical_string(b)


@pytest.mark.parametrize(("a", "b"), [("x2", "x²"), ("1", "①"), ("a b", "a  b"), ("A", "a"), ("a\nb", "a b"), ("R", "𝑅"), ("　", " ")])
def test_can_be_told_apart(a, b):
    assert c.canonical_string(a) != c.canonical_string(b)


def brute(rows):
    distinct = sorted({r for r in rows if r[0] is not None and r[1] is not None})
    return {(a, b) for a, x in distinct for b, y in distinct if a < b and x != y and c.canonical_string(x) == c.canonical_string(y)}


@pytest.mark.parametrize("salts", [1, 16])
def test_pairs_are_the_brute_force_pairs(spark, salts):
    rows = [("a", "x1"), ("b", "ｘ１"), ("c", "x1"), ("c", "x1"), ("d", "x²"), ("e", None), (None, "x1"), ("f", ""), ("g", "​"), ("h", "long " * 5000), ("i", "lоng " * 5000), ("j", "x１")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "key string, text string, form int")
    got = c.lookalike_pairs(df, "key", salts=salts).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_a_hot_group_of_copies_makes_no_pairs(spark):
    df = spark.range(3000).selectExpr("cast(id as string) AS key", "if(id = 7, 'ａ', if(id % 3 = 0, 'b', 'a')) AS text")
    got = c.lookalike_pairs(df, "key").collect()
    assert len(got) == sum(1 for i in range(3000) if i % 3 and i != 7)
    assert all("7" in tuple(r) for r in got)


def test_texts_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "ａ", "old"), (2, None, "old"), (2, None, "old"), (3, "", None)], "id int, text string, canonical string")
    assert sorted((r.id, r.canonical) for r in c.canonical_texts(df).collect() if r.canonical is not None) == [(1, "a"), (3, "")]
    assert c.canonical_texts(df).count() == 4
    assert c.canonical_texts(df.limit(0)).count() == 0 and c.lookalike_pairs(df.limit(0).selectExpr("cast(id as string) AS key", "text"), "key").count() == 0


def test_decomposed_and_composed_forms_are_one():
    import unicodedata

    for point in [*range(0x80, 0xD800), *range(0xF900, 0x1E000), *range(0x2F800, 0x2FA20)]:
        char = chr(point)
        parts = unicodedata.normalize("NFD", char)
        if parts != char:
            assert c.canonical_string(f"x{parts}y") == c.canonical_string(f"x{char}y"), hex(point)


@pytest.mark.parametrize(("a", "b"), [("\u1100\u1161", "\uac00"), ("\uac00\u11a8", "\uac01"), ("\u09c7\u09be", "\u09cb"), ("ɡ", "g"), ("ν", "v"), ("Ӏ", "l")])
def test_syllables_and_variants(a, b):
    assert c.canonical_string(a) == c.canonical_string(b)


def test_classes_count_the_links(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "ｘ"), ("c", "ｘ"), ("c", "ｘ"), ("d", "y"), ("e", None)], "key string, text string")
    got = {r.row_key: (r.form, r.members, r.links) for r in c.lookalike_classes(df, "key").collect()}
    assert {k: v[1:] for k, v in got.items()} == {"a": (3, 2), "b": (3, 1), "c": (3, 1)} and len({v[0] for v in got.values()}) == 1
