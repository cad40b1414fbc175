"""Marking of fixed answers, pruning of fragments, weak areas, and tables that change."""

import pytest
from pyspark.sql import functions as F

from coursemill.functions import components, entries
from coursemill.functions import marking as m
from coursemill.operators import changes, grading, insights

ROWS = "kind string, key string, selected array<string>, answer string"


@pytest.mark.parametrize(
    ("kind", "key", "selected", "answer", "right"),
    [
        ("choice", "A、C", ["c", "A"], None, True), ("choice", "答案为 B", ["A"], None, False), ("choice", "见解析", ["A"], None, None), ("choice", "A", [], None, None), ("choice", "AF", ["A"], None, None), ("choice", None, ["A"], None, None),
        ("true_false", "正确。", ["正确"], None, True), ("true_false", "标准答案：错误", ["正确"], None, False), ("true_false", "正确", ["正确", "错误"], None, None),
        ("fill_blank", r"答案：$\omega_0 = 5\,\mathrm{V}$", None, "ω_0=5V。", True), ("fill_blank", "5 V", None, "6 V", False), ("fill_blank", "因为 5", None, "5", None), ("fill_blank", "5", None, "", None), ("fill_blank", "5\n6", None, "5", None),
        ("design", "A", ["A"], "A", None), (None, None, None, None, None),
    ],
)
def test_fixed_answers(spark, kind, key, selected, answer, right):
    df = spark.createDataFrame([(kind, key, selected, answer)], ROWS)
    labels = F.array(*map(F.lit, "ABCD"))
    assert df.select(m.is_right(F.col("kind"), F.col("key"), labels, F.col("selected"), F.col("answer")).alias("r")).first().r is right


def test_fragments_are_those_of_brute_force(spark):
    long, longer = "the output of the stage reaches the next one through a capacitor", "the output of the stage reaches the next one through a capacitor, so both set the rise time of it"
    texts = [(1, f"x {longer} y {long}"), (2, long), (3, f"{long}{long}"), (4, None), (5, ""), (6, "短" * 60), (7, f"{long[:49]}"), (8, "a" * 200_000 + long)]
    fragments = [long, longer, long, None, "short", "短" * 55, "     " * 20]
    df = spark.createDataFrame([(*r, "z") for r in texts], "id int, text string, fragment string").select("id", "text")
    got = {r.id: (r.text, r.removed) for r in grading.prune_fragments(df, "id", "text", spark.createDataFrame([(f,) for f in fragments], "fragment string")).collect()}
    want = {}
    for key, text in texts:
        known = sorted({f for f in fragments if f and len(f.replace(" ", "")) >= 50 and text and f in text and text.strip() != f.strip()}, key=lambda f: (-len(f), f))
        for f in known:
            text = text.replace(f, "")
        if known:
            want[key] = (text, len(known))
    assert got == want and set(got) == {1, 3, 6, 8}
    assert grading.prune_fragments(df.limit(0), "id", "text", spark.createDataFrame([], "fragment string")).count() == 0


def test_weakness_report(spark):
    rows = [("s", 1, "a", "c1", ["x", "y", "x"]), ("s", 2, "b", "c2", ["x"]), ("s", 3, "a", "c2", ["x", " "]), ("t", 4, "a", "c1", ["y"])]
    got = {(r.student_id, r.tag): r for r in insights.weakness_report(spark.createDataFrame(rows, "student_id string, request_id int, source string, chapter string, tags array<string>")).collect()}
    x = got["s", "x"]
    assert (x.mistakes, x.sources, x.chapter, x.score, x.severity, x.priority, x.sufficient) == (3, 2, "c2", 42, "severe", 1, True)
    assert not got["t", "y"].sufficient and set(got) == {("s", "x"), ("s", "y"), ("t", "y")}


def test_prerequisites_fall_back_only_where_no_edge_is(spark):
    edges = spark.createDataFrame([("a", "PRECEDES", "b"), ("c", "REQUIRES", "a"), ("c", "MENTIONS", "z"), ("a", "PRECEDES", "b")], "source string, type string, target string")
    before = spark.createDataFrame([("b", "old", 0.45, 1), ("d", "old", 0.45, 1)], "concept string, prerequisite string, confidence double, rank bigint")
    got = {(r.concept, r.prerequisite, r.confidence) for r in insights.prerequisites_or_before(edges, before).collect()}
    assert got == {("b", "a", 0.95), ("c", "a", 0.95), ("d", "old", 0.45)}


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "z")], "id int, name string, note string")
    new = spark.createDataFrame([(1, "q"), (1, "p"), (9, "gone")], "id int, name string")
    once = changes.update(base, new, ["id"])
    assert {tuple(r) for r in once.collect()} == {(1, "q", "x"), (2, "b", None), (3, None, "z")} == {tuple(r) for r in changes.update(once, new, ["id"]).collect()}
    names = changes.insert_unique(base.select("name"), spark.createDataFrame([("A",), ("c",), ("C",), (None,)], "name string"), "name")
    assert sorted(r.name or "" for r in names.collect()) == ["", "C", "a", "b"]
    renamed = changes.rename(base, spark.createDataFrame([(1, "B"), (2, "B"), (8, "n")], "id int, name string"), "id", "name")
    assert {r.id: r.name for r in renamed.collect()} == {1: "a", 2: "B", 3: None}
    left = changes.delete_cascade({"t": base, "u": base.limit(0)}, base.where("id = 1"), ["id"])
    assert sorted(r.id for r in left["t"].collect()) == [2, 3] and left["u"].count() == 0
    flagged = changes.referenced(base, base.where("id = 3"), ["id"], "known")
    assert {r.id: r.known for r in flagged.collect()} == {1: False, 2: False, 3: True}


def test_components(spark):
    part = "array<struct<id:string,type:string,terminals:array<string>>>"
    rows = [([("R1", "resistor", ["a", " b "]), ("x9", "npn", None), ("", "port", ["c"]), (None, None, [])],), (None,), ([],)]
    got = [r.n for r in spark.createDataFrame(rows, f"c {part}").select(components.netlist(F.col("c")).alias("n")).collect()]
    assert got == ["R1 a b UNKNOWN\nQx9 UNKNOWN_NODE UNKNOWN\n* PORT 3 c\nX4 UNKNOWN_NODE UNKNOWN", "", ""]
    role = lambda s, k, e=None, c=None: spark.range(1).select(components.role(F.lit(s), F.lit(k), None if e is None else F.lit(e), None if c is None else F.lit(c)).alias("r")).first().r
    assert role("R_{L}", "") == "负载电阻" and role("C1", "capacitor") == "输入耦合电容" and role("C7", "capacitor") == "电容" and role(None, None) == "电路元件" and role("R0", "x") == "输出电阻"
    assert role("R5", "resistor", "反馈 R5") == "反馈" and role("R5", "resistor", "unknown", "其中集电极电阻R5很大") == "集电极电阻"


def test_entries(spark):
    got = spark.range(1).select(
        entries.stored_note(F.lit(" a  \n b\t\n\n")).alias("n"), entries.option_columns(F.lit("4")).alias("c"), entries.option_columns(F.lit(None)).alias("d"), entries.figure_position(F.lit(None)).alias("p"),
        entries.is_concept(F.lit("npn")).alias("x"), entries.is_concept(F.lit("1.2 增益")).alias("y"), entries.joined_once(F.array(F.lit("b"), F.lit(None)), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("b"))).alias("j"),
    ).first()
    assert (got.n, got.c, got.d, got.p, got.x, got.y, got.j) == ("a\n b", 4, 1, "after_question", False, True, ["b", "a"])
