"""Hits, references, context, attachments, slices, calendars, captions."""

from pyspark.sql import functions as F

from coursemill.operators import context, layout


def test_context_and_citations(spark):
    rows = [("q", 2, "s", "c", "s", None, "two"), ("q", 1, "s", "", None, 4, None), ("p", 1, None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "q string, rank int, source string, chapter string, section string, page int, text string")
    got = {r.q: r.context for r in context.context(df, "q", "rank").collect()}
    assert got["q"] == "[资料1] 来源=s · 4\n\n\n[资料2] 来源=s · c\ntwo" and got["p"] == "[资料1] 来源=\nx"
    answers = spark.createDataFrame([("q", "see [2], [资料2] and [9]"), ("p", None)], "q string, answer string")
    assert [(r.q, r["rank"]) for r in context.cited(df, "q", "rank", answers).collect()] == [("q", 2)]


def test_hits(spark):
    df = spark.createDataFrame([(1, 0.123456, "x" * 500, [str(i) for i in range(12)]), (2, None, None, None)], "id int, score double, text string, knowledge_tags array<string>")
    a, b = context.hits(df, ["score"]).orderBy("id").collect()
    assert (a.score, len(a.excerpt), len(a.tags)) == (0.1235, 360, 8) and (b.score, b.excerpt, b.tags) == (0.0, None, [])


def test_attachments(spark):
    requests = spark.createDataFrame([(1, ["a", "b", "a", "zz"]), (2, []), (3, None), (4, ["c"])], "k int, attachment_ids array<string>")
    files = spark.createDataFrame([("a", "A", "text a"), ("b", "B", None), ("c", "C", "y" * 50_000)], "id string, name string, text string")
    got = {r.k: r.attached for r in context.attachments(requests, files, "k").collect()}
    assert got[1] == "[附件：A]\ntext a\n\n[附件：B]\n" and set(got) == {1, 4} and len(got[4]) == 24_000 + len("[附件：C]\n")


def test_each_file_is_consumed_once(spark):
    m = spark.createDataFrame([("s", 1, "f"), ("s", 5, "f"), ("s", 6, "f"), ("s", 2, "g")], "s string, seq int, name string")
    f = spark.createDataFrame([("s", "i2", "f"), ("s", "i1", "f"), ("t", "i3", "g")], "s string, id string, name string")
    assert sorted((r.seq, r.id) for r in context.consume_by_name(m, f, "s").collect()) == [(1, "i1"), (5, "i2")]


def test_slices_and_picks(spark):
    df = spark.createDataFrame([("a" * 9 + "\n\n \n\nbc",), ("",), (None,)], "t string")
    assert [r.s for r in df.select(context.response_slices(F.col("t"), 4).alias("s")).collect()] == [["aaaa", "aaaa", "a", "bc"], [], []]
    rows = spark.createDataFrame([("g", i, 7) for i in range(5)], "g string, i int, s int")
    assert context.pick(rows, "g", "i", F.col("s")).first().i == 2


def test_calendar(spark):
    df = spark.createDataFrame([("2024-03-05",), ("2024-03-05",), (None,)], "d string")
    got = context.calendar(df, "d").orderBy("day").collect()
    assert len(got) == 42 and str(got[0].day) == "2024-02-26" and [r.n for r in got if str(r.day) == "2024-03-05"] == [2]


def test_captions_and_largest(spark):
    schema = "id string, page string, bbox array<double>"
    figures = spark.createDataFrame([("f", "p", [0.0, 0.0, 100.0, 100.0]), ("g", "p", [0.0, 900.0, 10.0, 910.0])], schema)
    captions = spark.createDataFrame([("a", "p", [0.0, 110.0, 100.0, 120.0]), ("b", "p", [0.0, 240.0, 100.0, 250.0]), ("c", "p", None)], schema)
    assert [(r.id, r.caption_id, r.cost) for r in layout.nearest_caption(figures, captions, ["page"]).collect()] == [("f", "a", 10.0)]
    boxes = spark.createDataFrame([("whole", "p", [0.0, 0.0, 100.0, 100.0]), ("part", "p", [0.0, 0.0, 50.0, 50.0]), ("aside", "p", [200.0, 0.0, 220.0, 20.0])], schema)
    assert sorted(r.id for r in layout.keep_largest(boxes, ["page"]).collect()) == ["aside", "whole"]
