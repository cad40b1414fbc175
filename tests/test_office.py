"""Word files, spreadsheets, attachments and what a collection keeps."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from coursemill.sources import collections, office

W, S = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_png", ".png"), data)
    return out.getvalue()


def word(*paragraphs, **more):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t[:2]}</w:t></w:r><w:r><w:t>{t[2:]}</w:t></w:r></w:p>' for s, t in paragraphs)
    styles = f'<w:styles xmlns:w="{W}"><w:style w:styleId="a1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="a2"><w:name w:val="标题 2"/></w:style></w:styles>'
    return archive(word__document_xml=f'<w:document xmlns:w="{W}"><w:body>{body}<w:tbl><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tbl></w:body></w:document>', word__styles_xml=styles, **more)


def sheet(rows):
    shared, cells = [], []
    for r, row in enumerate(rows, 1):
        line = ""
        for c, text in enumerate(row):
            if text is None:
                continue
            shared.append(text)
            line += f'<c r="{chr(65 + c)}{r}" t="s"><v>{len(shared) - 1}</v></c>'
        cells.append(f'<row r="{r}">{line}</row>')
    strings = "".join(f"<si><t>{x}</t></si>" for x in shared)
    return archive(xl__worksheets__sheet1_xml=f'<worksheet xmlns="{S}"><sheetData>{"".join(cells)}</sheetData></worksheet>', xl__sharedStrings_xml=f'<sst xmlns="{S}">{strings}</sst>')


def test_word_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word(("x", "before"), ("a1", "Chapter one"), ("x", "first"), ("x", " "), ("x", "second"), ("a2", "Part"), ("x", "third")))
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "empty.docx").write_bytes(word())
    got = [tuple(r)[1:] for r in office.read_docx(spark, str(tmp_path)).orderBy("block").collect()]
    assert got == [(0, "", "", "before"), (1, "Chapter one", "Chapter one", "first\nsecond"), (2, "Chapter one", "Part", "third")]


def test_question_banks(spark, tmp_path):
    head = ["题号", "题目文本", "知识点标签", "标准答案", "难度", "别的"]
    (tmp_path / "bank.xlsx").write_bytes(sheet([["title"], [], head, ["Q1", "what", "a，b; c", "5 V", None, "x"], ["Q2", None, "a", "b"], ["Q3", "why", None, None, "难"]]))
    (tmp_path / "short.xlsx").write_bytes(sheet([["题号", "题目文本"], ["Q9", "left out"]]))
    (tmp_path / "broken.xlsx").write_bytes(b"x")
    got = {r.question_id: (r.question_text, r.knowledge_tags, r.standard_answer, r.difficulty, r.question_type) for r in office.read_xlsx_bank(spark, str(tmp_path)).collect()}
    assert got == {"Q1": ("what", ["a", "b", "c"], "5 V", "基础", "综合题"), "Q3": ("why", [], "", "难", "综合题")}


def test_attachments(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word(("x", "hello"), word__media__b_png=b"12", word__media__a_png=b"1", word__media__c_png=b""))
    (tmp_path / "b.xlsx").write_bytes(sheet([["a", "b"]] * 200))
    (tmp_path / "c.txt").write_text("é" * 30_000)
    (tmp_path / "d.bin").write_bytes(b"\x00")
    got = {r.file: (r.text, r.pictures) for r in office.read_attachments(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("hello", ["word/media/a.png", "word/media/b.png"]) and got["d.bin"] == ("", [])
    assert got["b.xlsx"][0].count("\n") == 119 and len(got["c.txt"][0]) == 24_000


def test_vectors_of_different_lengths_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [])], "id int, v array<float>")
    collections.write_vectors(df, str(tmp_path / "v"), "id", "v", "a")
    assert [(r.id, [round(x, 4) for x in r.v]) for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [(1, [0.6, 0.8])]
    assert collections.drop_collection(spark, str(tmp_path / "v"), "a") and not collections.drop_collection(spark, str(tmp_path / "v"), "a")
    with pytest.raises(ValueError):
        collections.write_vectors(df.unionByName(spark.createDataFrame([(4, [1.0])], df.schema)), str(tmp_path / "w"), "id", "v", "a")


def test_a_state_that_is_not_there_is_empty(spark, tmp_path):
    assert collections.read_state(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text('[{"a": 1}, {"a": null}]')
    (tmp_path / "s" / "y.json").write_text('{"a": 2}{')
    assert sorted(str(r.a) for r in collections.read_state(spark, str(tmp_path / "s"), "a int").where(F.lit(True)).collect())[:2] == ["1", "None"]
