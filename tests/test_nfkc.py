"""Lines of pages under NFKC, against a plain loop."""

import unicodedata

from coursemill.operators import cleaning

PAGES = [("p1", "s", "ＡＢ① head\n１２３\n電圧 Ｕｏ = ５\nend"), ("p2", "s", "AB1 head\nx，y\n４５\nlast"), ("p3", "s", "ＡＢ1　head\nbody ﬁne\n－ ７ －\nstop"), ("p4", "s", None)]


def test_lines_are_composed_before_they_are_judged(spark):
    pages = cleaning.composed(spark.createDataFrame(PAGES, "page_id string, source string, text string"))
    lines = {(p, n): "".join(x.split()) for p, _, text in PAGES if text for n, x in enumerate(unicodedata.normalize("NFKC", text).split("\n"), 1)}
    got = {(r.page_id, r.line_no): r.line for r in cleaning.page_lines(pages).collect()}
    assert {k: v.replace(" ", "") for k, v in got.items()} == lines
    assert got["p1", 1] == got["p2", 1] == got["p3", 1] == "AB1 head"
    assert [(r.source, r.line, r.n) for r in cleaning.edge_noise(pages).collect()] == [("s", "AB1 head", 3)]
    kept = {(r.page_id, r.line_no) for r in cleaning.clean_lines(pages).collect()}
    assert kept == {("p1", 3), ("p1", 4), ("p2", 2), ("p2", 4), ("p3", 2), ("p3", 4)}


def test_clean_pages_compose_their_text(spark):
    pages = spark.createDataFrame(PAGES, "page_id string, source string, text string")
    got = {r.page_id: r.cleaned for r in cleaning.clean_pages(pages).collect()}
    assert sorted(got) == ["p1", "p2", "p3"] and "123" not in got["p1"] and "１２３" not in got["p1"] and got["p3"] == "body fine stop"
    assert all(unicodedata.is_normalized("NFKC", x) for x in got.values())
