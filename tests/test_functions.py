"""Functions on circuits, formulas, headings, questions and models."""

import pytest
from pyspark.sql import functions as F

from coursemill.functions import circuits, formulas, headings, models
from coursemill.operators import questions


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


PART = "array<struct<id:string,type:string,terminals:array<string>>>"


def test_circuits(spark):
    df = spark.createDataFrame([([("R1", "resistor", ["a", "b"]), ("C2", "capacitor", ["b", None])], 0.9, "x"), ([("R1", "resistor", ["a"]), ("k9", "thing", None)], 0.9, "等效模型"), ([("R1", "resistor", ["a"])], 0.9, "电路"), (None, None, None)], f"c {PART}, p double, w string")
    rows = df.select(circuits.netlist(F.col("c")).alias("n"), circuits.is_circuit(F.col("c"), F.col("p"), F.col("w")).alias("ok")).collect()
    assert rows[0].n == "R1 a b resistor\nC2 b UNKNOWN capacitor" and rows[1].n.splitlines()[1] == "X_k9 UNKNOWN UNKNOWN thing"
    assert [r.ok for r in rows] == [True, True, False, False]
    got = one(spark, a=circuits.label(F.lit("R_{1}"), F.lit("")), b=circuits.role(F.lit("Zz"), F.lit("relay")), c=circuits.role(F.lit("RV3"), F.lit(None).cast("string")))
    assert (got.a, got.b, got.c) == ("电阻 R_{1}", "relay", "可调电阻")


def test_formulas(spark):
    got = one(
        spark, a=formulas.looks_like_formula(F.lit("U=I*R")), b=formulas.looks_like_formula(F.lit("text")), c=formulas.looks_like_table(F.lit("a\tb\nc\td\n\nx  y")),
        d=formulas.reconcile(F.lit("U_o = I R"), F.lit("U_{o}=IR")), e=formulas.candidates(F.lit("文字\n U=IR \n这是一个很长的句子=1")), f=formulas.quantities(F.lit("A_{v}=R_{o}/R_i, A_v")),
    )
    assert (got.a, got.b, got.c, got.d, got.e, got.f) == (True, False, True, "U_{o}=IR", ["U=IR"], ["电压增益", "输入电阻", "输出电阻"])


def test_headings(spark):
    got = one(
        spark, a=headings.chapter_heading(F.lit("第 2 章  基本放大电路")), b=headings.chapter_heading(F.lit("第2章讲过，电路如下。")), c=headings.section_heading(F.lit("1.2.3 偏置电路")),
        d=headings.special_chapter(F.array(F.lit("x"), F.lit("参考 文献"))), e=headings.repaired_key(F.lit("ch1-2.3"), F.lit("2.4")), f=headings.captions(F.lit("见图 2.1 与图3，图 2.1")), g=headings.points(F.lit("(5分) 求")), h=headings.caption_part(F.lit("图1（b）")), i=headings.part_label(F.lit("（1）.")),
    )
    assert (got.a, got.b, got.c, got.d, got.e, got.g, got.h, got.i) == ("第2章 基本放大电路", None, "1.2.3 偏置电路", "参考文献", "ch1-2.4", 5.0, "b", "1")
    assert got.f == ["图 2.1", "图3"]


def test_labels():
    assert questions.split_labels("求：(1)增益；(2)带宽，见(1)式") == ("求：", [("1", "增益；"), ("2", "带宽，见(1)式")])
    assert questions.split_labels("只有(1)一处") == ("只有(1)一处", []) and questions.split_labels(None) == ("", [])


def test_assembly(spark):
    schema = "question_key string, seq int, number string, text string, option_label string, option_text string, points double, page int"
    rows = [("k", 2, "1", "Find the gain.", "A", "ten", 3.0, 4), ("k", 1, "", "Find the gain", "A", "ten volts", None, 3), ("k", 3, "9", None, "B", "two", 5.0, 4), (None, 1, "1", "x", None, None, None, 1)]
    got = questions.assemble(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1
    q = got[0]
    assert (q.number, q.prompt, [(o.label, o.text) for o in q.options], q.points, q.page_start, q.page_end) == ("1", "Find the gain", [("A", "ten volts"), ("B", "two")], 5.0, 3, 4)


def test_parts_options_and_json(spark):
    got = spark.createDataFrame([("求(1)a(2)b", ["x", " ", "y"], 'so:\n```json\n{"a": 1}\n```')], "t string, o array<string>, j string").select(
        questions.labelled_parts("t").alias("p"), questions.options(F.col("o")).alias("o"), questions.first_json(F.col("j"), "a int").alias("j")
    ).first()
    assert [(x.label, x.text) for x in got.p] == [("1", "a"), ("2", "b")] and [(x.label, x.text) for x in got.o] == [("A", "x"), ("C", "y")] and got.j.a == 1


@pytest.mark.parametrize(("text", "want"), [("1+2*3", 7), ("sqrt(16)/Rational(1,2)", 8), ("2**0.5", 2**0.5), ("__import__('os')", None), ("1/0", None), ("x", None), ("9**999", None), (None, None)])
def test_calculator(text, want):
    assert models.calculate(text) == (pytest.approx(want) if want is not None else None)


def test_models(spark):
    df = spark.createDataFrame([("gain of stage", "2*3", "6.0001"), (None, "x", "1"), ("", "1/3", "0.33333")], "t string, a string, b string")
    rows = df.select(models.embed(F.col("t"), 16).alias("v"), models.equals("a", "b").alias("e")).collect()
    assert [len(r.v) for r in rows] == [16] * 3 and sum(x * x for x in rows[0].v) == pytest.approx(1, abs=1e-5) and set(rows[1].v) == {0.0}
    assert [r.e for r in rows] == [True, False, True]
