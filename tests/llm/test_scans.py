"""Problem 3: noise of scans, on texts with known noise."""

import random

import numpy as np
import pandas as pd
import pytest

from coursemill.functions import codepoints as cp
from coursemill.llm import scans as s

SENTENCES = ["The load current of the amplifier rises with the supply", "A band-pass filter keeps the signal voltage within limits", "First measure the input resistance then record the gain", "负载电流随着电源电压的变化而变化", "测量输入电阻之后再接入滤波电容", "误差主要来自温度漂移和静态工作点"]


def book(pages: int, seed: int = 3) -> pd.DataFrame:
    rng = random.Random(seed)
    rows = []
    for n in range(1, pages + 1):
        lines = [x for _ in range(6) for x in (rng.choice(SENTENCES[:3]) + " and so on.", rng.choice(SENTENCES[3:]) + "。")]
        noise = set()
        if n % 2 == 0:
            lines.insert(0, "Practical Circuit Course")
            noise.add("header")
        if n % 3 == 0:
            lines.append(f"- {n + 4} -")
            noise.add("page_number")
        if n % 35 == 0:
            lines[3] = "the v0ltage of the arnplifier, 输入电阳之后再接"
            noise.add("misread")
        if n % 7 == 0:
            lines[5] = "the cur-\nrent of a band-\npass filter"
            noise.add("hyphen")
        if n % 4 == 0:
            lines.insert(6, "1.2 Practical work")
            lines.insert(7, "417")
        rows.append(("page_documents", f"p{n:04d}", "\n".join(lines), "Practical Circuit Course", ["Chapter 1 Basics"], n + 4, noise))
    return pd.DataFrame(rows, columns=["tbl", "row_key", "text", "title", "chapters", "printed", "noise"])


@pytest.fixture(scope="module")
def found(spark):
    pdf = book(420)
    df = spark.createDataFrame(pdf.drop(columns="noise"), s.ROW_SCHEMA)
    editor = s.fit(df)
    got: dict[str, set[str]] = {}
    for r in s.find_noise(df.union(df.limit(5)), editor).collect():
        got.setdefault(r.row_key, set()).add(r.noise)
    return pdf, got, editor, df


def test_noise_is_found(found):
    pdf, got, _, _ = found
    for kind in ("header", "page_number", "misread", "hyphen"):
        want = set(pdf[pdf.noise.map(lambda x: kind in x)].row_key)
        have = {k for k, v in got.items() if kind in v}
        assert len(want & have) >= 0.95 * len(want), kind
        assert len(have - want) <= 0.05 * len(want) + 1, kind


def test_texts_are_repaired(found):
    _, _, editor, df = found
    text = s.repair_texts(df.where("row_key = 'p0210'"), editor).first().repaired
    assert "voltage of the amplifier" in text and "输入电阻之后" in text and "current of a band-pass filter" in text
    assert "Practical Circuit Course" not in text and "- 214 -" not in text


def test_edge_cases(spark, found):
    _, _, editor, df = found
    odd = spark.createDataFrame([("t", "a", "", None, None, None), ("t", "b", "x" * 200_000, None, None, None), ("t", "c", "\n\n-\n", "T", [None, ""], 3)], s.ROW_SCHEMA)
    assert s.find_noise(odd, editor).count() == 0
    assert s.find_noise(df.limit(0), editor).count() == 0 and s.repair_texts(odd, editor).count() == 3


def test_rows_take_the_usual_shift(spark):
    page = "page_id string, id string, text string, source string, page int, source_page int, chapter string, title string"
    pages = spark.createDataFrame([("p1", "", "x", "s", 1, 5, "c", "z"), ("p2", "", "x", "s", 2, 6, "", "z"), ("p3", "", "x", "s", 3, None, None, "z"), ("p4", "", None, "s", 4, None, "c", "z"), ("p5", "", "x", None, 4, None, "c", "z")], page)
    got = {r.row_key: (r.printed, r.chapters) for r in s.page_rows(pages, pages.limit(0), spark.createDataFrame([("s", "T")], "source string, title string")).collect()}
    assert got == {"p1": (5, ["c"]), "p2": (6, ["c"]), "p3": (7, ["c"]), "p5": (None, ["c"])}


def test_counts_are_never_too_small(spark):
    texts = ["alpha beta alpha", "alpha 电路图 电路图", "beta-gamma\nalpha"]
    df = spark.createDataFrame([("t", str(i), t, None, None, None) for i, t in enumerate(texts)], s.ROW_SCHEMA)
    counts = s.count_corpus(df)
    assert counts.word("alpha") == 4 and counts.word("nothing") == 0
    a, b, c = (np.array([ord(x)], np.uint32) for x in "电路图")
    assert counts.of(s.trigram_key(a, b, c))[0] == 2


def test_word_positions():
    import pyarrow as pa

    p = s.parse(*cp.flatten(pa.array(["cur­\nrent flow", "", "b-c"])))
    before, after = s.at_line_edge(p)
    assert p.words(np.arange(len(p.starts))) == ["cur", "rent", "flow", "b", "c"]
    assert before.tolist() == [True, False, False, False, False] and after.tolist() == [False, True, False, False, False]


def counts_of(numbers):
    table = np.zeros((2, 1 << s.TABLE_BITS), np.uint32)
    for key, n in numbers:
        a, b = s.Counts.cells(np.array([key], np.uint64))
        table[0][a] += n
        table[1][b] += n
    return s.Counts(table)


def test_confusions_that_are_not_listed_are_learned():
    good = ["window", "switching", "crown", "bandwidth", "power", "flow", "lower"]
    bad = [w.replace("w", "uv", 1) for w in good] + ["poker"]
    listed = {*s.CONFUSIONS}
    assert ("uv", "w") not in listed and ("k", "w") not in listed
    counts = counts_of([(int(s._word_key([w])[0]), 900) for w in good] + [(int(s._word_key([w])[0]), 2) for w in bad])
    assert s.learn_latin({*good, *bad}, counts) == [("uv", "w")]  # a single word supports no confusion


def test_ordinary_variants_are_no_confusions():
    words = [f"{stem}{end}" for stem in ("filter", "stage", "meter", "signal", "relay", "diode") for end in ("", "s")]
    counts = counts_of([(int(s._word_key([w])[0]), 900 if not w.endswith("s") else 300) for w in words])
    assert s.learn_latin(set(words), counts) == []


def test_ideograph_confusions_are_learned():
    runs = [(ord(a), ord("洲"), ord(b)) for a, b in zip("电直交稳滤", "压流阻容感")]
    right = [(a, ord("测"), b) for a, _, b in runs]
    numbers = [(int(s.trigram_key(*(np.array([x], np.uint64) for x in r))[0]), n) for rows, n in ((runs, 1), (right, 400)) for r in rows]
    assert s.learn_ideographs(np.array(runs + right), counts_of(numbers)) == [("洲", "测")]


def test_sample_does_not_grow_with_partitions(spark, monkeypatch):
    from coursemill.llm.sampling import bounded_sample

    rows = spark.range(3000).selectExpr("'t' AS tbl", "string(id) AS row_key", "concat('text ', id) AS text", "'x' AS title", "array('c') AS chapters", "1 AS printed")
    assert len(bounded_sample(rows.repartition(10), 100)) == len(bounded_sample(rows.repartition(200), 100)) <= 200
