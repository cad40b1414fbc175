"""Problem 2: pieces of oversized items."""

from hypothesis import given, settings
from hypothesis import strategies as st

from coursemill.llm import splitting as s

TEXT = st.lists(st.sampled_from(["电路 ", "word ", "句子。", "End. ", "\n", "\n\n", "3.5 V ", "approx. ", "1.2 power stage\n", "x" * 40, "，"]), max_size=60).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(20, 80), st.integers(0, 15))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = s.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 <= b - a <= limit for a, b, _ in pieces)
    for (_, end, _), (start, stop, _) in zip(pieces, pieces[1:]):
        assert end - overlap <= start <= end < stop


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_forced_means_a_long_stretch(text):
    cuts = sorted({0, len(text), *(c for level in (2, 3) for c in s._cuts(text, 0, len(text), level))})
    longest = max((b - a for a, b in zip(cuts, cuts[1:])), default=0)
    if len(text) > 60:
        assert any(p[2] for p in s.split_text(text, 60, 10)) == (longest > 60)


def test_boundaries():
    text = "about approx. 3.5 V here. Next one。末句！"
    assert [text[:c] for c in s._cuts(text, 0, len(text), 3)] == ["about approx. 3.5 V here.", "about approx. 3.5 V here. Next one。"]


def test_pages():
    assert s.piece_pages(0, 10, 100, 5, 8) == (5, 5)
    assert s.piece_pages(90, 100, 100, 8, 5) == (8, 8)
    assert s.piece_pages(0, 10, 10, None, 3) == (3, 3)
    assert s.piece_pages(0, 10, 10, None, None) == (None, None)


def test_rows(spark):
    long = "句子很长。" * 300
    rows = [("a", long, 2, 1, "s", "z"), ("a", long, 2, 1, "s", "z"), ("b", "short", 1, 1, None, "z"), ("c", None, None, None, None, "z"), ("d", "x" * 2000, None, 3, "", "z"), ("e", "", 1, 1, "", "z")]
    df = spark.createDataFrame(rows, "id string, text string, page_start int, page_end int, section string, cut string")
    got = s.split_items(df)
    assert {(r.id, r.cut) for r in got.collect()} == {("a", "natural"), ("d", "forced")}
    assert got.where("id = 'a'").selectExpr("min(page_start)", "max(page_end)", "max(char_length(text))").first()[:2] == (1, 2)
    assert got.where("char_length(text) > 900").count() == 0
    assert s.split_items(df.limit(0)).count() == 0
