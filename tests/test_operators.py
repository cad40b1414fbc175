"""Core operators on small tables, with nulls, ties, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

from coursemill.functions import text as T
from coursemill.operators import changes, chunking, cleaning, fuzzy, grading, graph, insights, joins, layout, quality, search, sessions


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("limit", [0, 100])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_guarded_join_is_the_plain_join(spark, how, limit):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (1, "b")], "k int, v string")
    right = spark.createDataFrame([(1, 9), (1, 8), (3, 7), (None, 6)], "k int, w int")
    assert values(joins.guarded_join(left, right, ["k"], how, limit)) == values(left.join(right, "k", how))


def test_bm25_ranks_and_ties(spark):
    corpus = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "blue whale sea"), (4, None), (5, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "fox fox"), (8, "nothing")], "query_id long, query string")
    got = search.bm25_topk(corpus, queries, "doc_id", "query_id").orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [(7, 1, 1), (7, 2, 2)]
    assert search.bm25_topk(corpus.limit(0), queries, "doc_id", "query_id").count() == 0


def test_cosine_of_missing_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [3.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in search.vector_topk(v, q).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_min_max_of_equal_scores(spark):
    s = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (3, 1.0), (3, 3.0)], "q int, score double")
    assert values(s.select("q", search.min_max("score", "q").alias("s"))) == [(1, 1.0), (1, 1.0), (2, 0.0), (3, 0.0), (3, 1.0)]


def test_visual_lane_pins_two(spark):
    scores = spark.createDataFrame([(1, i, s) for i, s in ((1, 0.9), (2, 0.8), (3, 0.75), (4, 0.5))], "q int, k int, score double")
    text = spark.createDataFrame([(1, 3, 5.0), (1, 2, 4.0), (1, 9, 1.0)], "q int, k int, score double")
    assert [r.k for r in search.visual_lane(scores, text, "q", "k", 4).orderBy("rank").collect()] == [1, 2, 3, 9]


def test_lines_and_noise(spark):
    page = spark.createDataFrame([("p", "s", "第1章 基础\n\n- 12 -\n看 www.a.com\nPN 结  的特性\n扫码关注")], "page_id string, source string, text string")
    lines = {r.line_no: r.line for r in cleaning.page_lines(page).collect()}
    assert lines[5] == "PN结的特性" and lines[2] == ""
    assert [r.line_no for r in cleaning.page_lines(page).where(~T.is_line_noise("line")).orderBy("line_no").collect()] == [1, 4, 5]


def test_edge_noise_counts_short_pages_twice(spark):
    pages = spark.createDataFrame([(f"p{i}", "s", "title\nbody %d\nmore\nother\nlast" % i) for i in range(3)] + [("q", "t", "one"), ("r", "t", "one")], "page_id string, source string, text string")
    assert values(cleaning.edge_noise(pages)) == [("s", "last", 3), ("s", "other", 3), ("s", "title", 3), ("t", "one", 4)]


def test_as_of_takes_the_last_mark(spark):
    marks = spark.createDataFrame([("s", 1, "a"), ("s", 5, "b"), ("s", 9, None)], "source string, page int, chapter string")
    rows = spark.createDataFrame([("s", 0, "w"), ("s", 5, "x"), ("s", 7, "y"), ("s", 9, "z"), ("t", 3, "v")], "source string, page int, id string")
    got = {r.id: r.chapter for r in cleaning.as_of(rows, marks, "source", "page", ["chapter"]).collect()}
    assert got == {"w": None, "x": "b", "y": "b", "z": None, "v": None}


def test_keep_decisions(spark):
    rows = spark.createDataFrame([("s", i, str(i), t) for i, t in enumerate(["body", "exercise", "body", "chapter", "body"])], "source string, page int, page_id string, text string")
    got = cleaning.keep_decisions(rows, F.col("text") == "exercise", F.col("text") == "chapter").orderBy("page").collect()
    assert [r.keep for r in got] == [True, False, False, True, True]


def test_reflow():
    assert cleaning.reflow(["第1章 基础", "电流流过", "电阻。", "next", "line."]) == ["第1章 基础", "电流流过电阻。", "next line."]
    assert cleaning.reflow([]) == []


def test_packing_respects_the_limit():
    text = "\n\n".join("句子%d很长。" % i * 9 for i in range(20))
    chunks = chunking.pack(text, 260, 40)
    assert all(len(c) <= 260 + 4 for c in chunks) and "".join(chunks).count("句子19") >= 9
    assert chunking.pack("", 260) == [] and [len(p) for p in chunking.sentence_pieces("x" * 700, 300)] == [300, 300, 100]


def test_element_chunks_drop_both_kinds_of_copies(spark):
    rows = spark.createDataFrame(
        [("a", "formula", "U = R I", "h1"), ("b", "formula", "other", "h1"), ("c", "table", "u=ri", None), ("d", "text", "U", None), ("e", "image", " ", None)],
        "id string, element_type string, text string, content_hash string",
    )
    assert [r.id for r in chunking.element_chunks(rows).collect()] == ["a"]


CHUNK = "id string, source string, chapter string, section string, page_start int, page_end int, doc_type string, knowledge_tags array<string>, element_type string, multimodal struct<components array<struct<id:string,type:string,terminals:array<string>>>, nets array<struct<id:string,terminals:array<string>>>>"


def test_graph_of_a_circuit(spark):
    circuit = ([("R1", "resistor", ["n1", "n2"])], [("n1", ["R1.1", "X.2"])])
    rows = [("c1", "s", "第1章 a", "x", 1, 2, "textbook", ["Bias", "bias "], "circuit", circuit), ("c2", "s", "第1章 a", None, 1, None, None, None, "text", None), ("q", "s", "c", "x", 1, 1, "question", ["z"], "text", None)]
    chunks = graph.distinct_chunks(spark.createDataFrame([*rows, rows[0]], CHUNK))
    nodes, edges = graph.nodes(chunks), graph.edges(chunks)
    assert {(r.type, r.n) for r in graph.node_totals(nodes).collect()} == {("document", 1), ("page", 1), ("chunk", 2), ("concept", 1), ("component", 1), ("net", 1)}
    assert {(r.type, r["count"]) for r in edges.groupBy("type").count().collect()} == {("HAS_PAGE", 1), ("HAS_CHUNK", 2), ("MENTIONS", 1), ("CONTAINS", 1), ("CONNECTED_TO", 1)}
    assert graph.dangling(nodes, edges).count() == 0
    assert graph.dangling(nodes.where("type <> 'net'"), edges).count() == 1
    summary = graph.chapter_summaries(chunks).first()
    assert (summary.page_start, summary.page_end, summary.concepts, summary.sections) == (1, 2, 1, 1)
    assert graph.nodes(chunks.limit(0)).count() == 0


def test_match_names(spark):
    points = spark.createDataFrame([("Bias-Current",), ("bias currents",), ("unrelated",), (None,), ("bias currents",)], "point string")
    names = spark.createDataFrame([("bias current",), ("load current",), (None,)], "name string")
    got = {r.point: (r.name, r.match) for r in fuzzy.match_names(points, names).collect()}
    assert got == {"Bias-Current": ("bias current", "exact"), "bias currents": ("bias current", "approximate"), "unrelated": (None, "custom")}


def test_near_duplicates_group_copies(spark):
    base = "how does the operating point move when the supply drops by half and the load stays the same " * 2
    rows = spark.createDataFrame([(1, base), (2, base.upper()), (3, base + "x"), (4, "something else entirely"), (5, None), (6, "")], "id long, t string")
    assert values(fuzzy.near_duplicates(rows, "id", "t")) == [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)]
    assert fuzzy.near_duplicates(rows.limit(0), "id", "t").count() == 0


def test_near_duplicates_lose_no_link(spark):
    import random

    rng = random.Random(1)
    texts = []
    for _ in range(12):
        base = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(60, 300)))
        texts.append(base)
        for _ in range(4):
            c = list(texts[-1])
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(c))
                c[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            texts.append("".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    parent = list(range(len(texts)))
    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] != texts[j] and fuzzy.ratio(texts[j], texts[i]) >= fuzzy.DUPLICATE or texts[i] == texts[j]:
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
                links[i] += texts[i] != texts[j]
                links[j] += texts[i] != texts[j]
    got = {r.id: (r.class_id, r.links) for r in fuzzy.near_duplicates(df, "id", "t").collect()}
    first = {t: min(i for i, u in enumerate(texts) if u == t) for t in texts}
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(parent))
    assert all(n == len({texts[j] for j in range(len(texts)) if texts[j] != texts[i] and fuzzy.ratio(*(texts[k] for k in sorted((first[texts[i]], first[texts[j]])))) >= fuzzy.DUPLICATE}) for i, (_, n) in got.items())


def test_carry_forward_over_blocks(spark):
    rows = [("s", i, "v%d" % i if i in (2, 5, 13) else None) for i in range(20)] + [(None, 3, "n"), (None, 9, None), ("s", None, None)]
    df = spark.createDataFrame(rows, "g string, at int, v string")
    got = {(r.g, r["at"]): r.last for r in cleaning.carry_forward(df, "g", ["at"], "v", "last", block=4).collect()}
    assert [got["s", i] for i in (0, 2, 4, 12, 13, 19)] == [None, "v2", "v2", "v5", "v13", "v13"]
    assert got[None, 9] == "n" and got["s", None] is None


def test_merge_parts():
    assert fuzzy.merge_parts(["Find the gain.", "find the gain", "", "State the units"]) == "Find the gain.\nState the units"


def test_weak_areas(spark):
    rows = [("s", "a", ["x", "x"]), ("s", "b", ["x"]), ("s", "a", ["y"]), ("s", None, [""]), (None, "a", ["x"]), ("t", "a", None)]
    got = insights.weak_areas(spark.createDataFrame(rows, "student_id string, source string, tags array<string>")).orderBy("priority").collect()
    assert [(r.tag, r.n, r.sources, r.score, r.severity) for r in got] == [("x", 2, 2, 27, "medium"), ("y", 1, 1, 10, "light")]


def test_chapter_of_tags_prefers_coverage(spark):
    tags = spark.createDataFrame([("o", "a"), ("o", "b"), ("o", "a")], "owner string, tag string")
    chunks = spark.createDataFrame([("1", "one", ["a", "b"]), *[(str(i), "many", ["a"]) for i in range(2, 9)]], "id string, chapter string, knowledge_tags array<string>")
    assert tuple(insights.chapter_of_tags(tags, chunks).first()) == ("o", "one", 2, 2)


def test_sessions(spark):
    m = [("user", "hello " * 10), ("assistant", "a")]
    rows = spark.createDataFrame([(1, "s", 2, m), (2, "s", 1, [("user", "first")]), (3, None, 1, m), (4, "t", 1, [])], "request_id long, session_id string, created_at long, messages array<struct<role:string,content:string>>")
    log = sessions.messages(rows)
    assert [(r.seq, r.role) for r in log.orderBy("seq").collect()] == [(1, "user"), (2, "user"), (3, "assistant")]
    assert sessions.summaries(log).first().title == "first"
    assert [r.asked for r in sessions.previous_user(log).orderBy("seq").collect()][:2] == [None, "first"]
    assert sessions.recent(log, 1).first().seq == 3


def test_distribution_keeps_the_total(spark):
    rows = spark.createDataFrame([(1, i, 10.0) for i in range(3)], "g int, n int, total double")
    shares = [r.share for r in grading.distribute(rows, "total", "g", "n").orderBy("n").collect()]
    assert shares == [3.33, 3.33, 3.34] and sum(shares) == pytest.approx(10)


def test_completed_and_missing(spark):
    want = spark.createDataFrame([(1,), (2,)], "k int")
    have = spark.createDataFrame([(1, 5.0)], "k int, score double")
    assert values(grading.completed(want, have, ["k"], "score")) == [(1, 5.0, False), (2, 0.0, True)]
    assert values(grading.missing(want, have, ["k"])) == [(2,)]


def test_leaked_later(spark):
    rows = spark.createDataFrame([("s", 1, "q one", "see q two please"), ("s", 2, "q two", "q one"), ("s", 3, None, None)], "s string, n int, question string, answer string")
    assert values(grading.leaked_later(rows, "s", "n", "answer", "question", 3)) == [("s", 1, 2)]


def test_suppression_and_overlap(spark):
    rows = [("a", "p", "t", [0.0, 0.0, 10.0, 10.0], 0.9), ("b", "p", "t", [0.0, 0.0, 10.0, 9.5], 0.8), ("c", "p", "t", [50.0, 0.0, 60.0, 10.0], None), ("d", "p", "t", None, 1.0), ("e", "p", "t", [5.0, 5.0, 5.0, 9.0], 1.0)]
    df = spark.createDataFrame(rows, "id string, page string, kind string, bbox array<double>, confidence double")
    assert values(layout.suppress(df, ["page", "kind"])) == [("a",), ("c",)]
    assert ("b", "a", 1.0) in values(layout.overlapping(df, df, ["page"]))
    assert df.where("id = 'a'").select(layout.iou(F.col("bbox"), F.array(*map(F.lit, (0.0, 0.0, 10.0, 5.0))))).first()[0] == 0.5


def test_nearest_in_column(spark):
    left = spark.createDataFrame([("f", "p", [0.0, 100.0, 50.0, 120.0])], "id string, page string, bbox array<double>")
    right = spark.createDataFrame([("a", "p", [0.0, 60.0, 50.0, 95.0]), ("b", "p", [0.0, 125.0, 50.0, 140.0]), ("c", "p", [400.0, 100.0, 450.0, 120.0]), ("d", "p", None)], "id string, page string, bbox array<double>")
    assert [(r.other, r["rank"]) for r in layout.nearest(left, right, ["page"]).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_upsert_and_once(spark):
    base = spark.createDataFrame([("k1", "old", 1), ("k2", "x", 2)], "k string, v string, n int")
    new = spark.createDataFrame([("k1", "", 7, 1), ("k1", "late", None, 2), ("k3", "y", 3, 1)], "k string, v string, n int, at int")
    assert values(changes.upsert(base, new, ["k"], "at")) == [("k1", "late", 1), ("k2", "x", 2), ("k3", "y", 3)]
    assert changes.append_once(base, base.union(base), "k").count() == 2
    assert changes.delete(base, base.limit(1), ["k"]).count() == 1


def test_expectations(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert values(quality.expect(df, {"known": F.col("x").isNotNull(), "small": F.col("x") < 3})) == [("known", 1, 3, False), ("small", 2, 3, False)]
    assert quality.expect(df.limit(0), {"known": F.col("x") > 0}).first().ok


def test_scalar_functions(spark):
    row = spark.createDataFrame([("1.2 放大 电路", "a，b; c,,", "[资料2] x [2][9] [1]", "$x$ and $", "A,C 和 A", " Yes ", "3.456")], "s string, tags string, cite string, cut string, choice string, flag string, num string")
    got = row.select(
        T.normalize_concept("s").alias("c"), T.split_tags("tags").alias("t"), T.citations("cite", 3).alias("k"), T.is_truncated("cut").alias("cut"),
        T.choice_labels("choice").alias("ch"), T.as_flag("flag").alias("f"), T.as_number("num").alias("n"), T.nfkc(F.lit("ＡＢ①")).alias("u"),
    ).first()
    assert (got.c, got.t, got.k, got.cut, got.ch, got.f, got.n, got.u) == ("放大 电路", ["a", "b", "c"], [2, 1], True, ["A", "C"], True, 3.46, "AB1")
