"""Word and spreadsheet files, which are archives of XML: paragraphs under headings, question banks, texts and pictures of attachments."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Names of the columns of a question bank, those it must have, and what stands where a cell is empty.
HEADERS = {
    "题号": "question_id", "编号": "question_id", "题目文本": "question_text", "题目": "question_text", "题目内容": "question_text", "知识点标签": "knowledge_tags", "知识点": "knowledge_tags",
    "标准答案": "standard_answer", "答案": "standard_answer", "难度": "difficulty", "难度等级": "difficulty", "题型": "question_type",
}
REQUIRED = ("question_id", "question_text", "knowledge_tags", "standard_answer", "difficulty")
HEADER_ROWS, DEFAULTS = 12, {"difficulty": "基础", "question_type": "综合题"}
#: Bounds of what an attachment gives to a conversation.
CHARS, ROWS, COLUMNS, PICTURE_BYTES = 24_000, 120, 12, 8 << 20
BANK = "file string, question_id string, question_text string, knowledge_tags array<string>, standard_answer string, difficulty string, question_type string"


def paragraphs(data: bytes) -> list[tuple[str, str]]:
    """(style, text) of the paragraphs of a Word file; tables are passed over, a broken file has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
            names = {}
            if "word/styles.xml" in archive.namelist():
                for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                    name = style.find(f"{_W}name")
                    names[style.get(f"{_W}styleId", "")] = name.get(f"{_W}val", "") if name is not None else ""
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        key = style.get(f"{_W}val", "") if style is not None else ""
        out.append((names.get(key, key), "".join(t.text or "" for t in p.iter(f"{_W}t"))))
    return out


def sections(data: bytes) -> list[tuple[str, str, str]]:
    """(chapter, section, text) of a Word file: a heading ends a block, one of the first level also sets the chapter."""
    chapter = section = ""
    out: list[tuple[str, str, str]] = []
    block: list[str] = []

    def close() -> None:
        text = "\n".join(block).strip()
        if text:
            out.append((chapter, section, text))
        block.clear()

    for style, text in paragraphs(data):
        if re.search("heading|标题", style, re.I) and text.strip():
            close()
            section = text.strip()
            if style.strip().endswith("1"):
                chapter = section
        elif text.strip():
            block.append(text.strip())
    close()
    return out


def cells(data: bytes, rows: int | None = None, columns: int | None = None) -> list[list[str]]:
    """The cells of the first sheet of a spreadsheet as text; a broken file has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = sorted((n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
            shared = []
            if "xl/sharedStrings.xml" in archive.namelist():
                shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
            sheet = ElementTree.fromstring(archive.read(names[0]))
    except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError):
        return []
    out = []
    for row in sheet.iter(f"{_S}row"):
        if rows is not None and len(out) >= rows:
            break
        line: dict[int, str] = {}
        for at, cell in enumerate(row.findall(f"{_S}c")):
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            place = at if not letters else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1
            value = cell.find(f"{_S}v")
            text = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if cell.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
            if cell.get("t") == "s" and text.isdigit() and int(text) < len(shared):
                text = shared[int(text)]
            if columns is None or place < columns:
                line[place] = text
        out.append([line.get(i, "") for i in range(max(line, default=-1) + 1)])
    return out


def bank_rows(data: bytes) -> list[dict]:
    """The questions of a spreadsheet whose header stands in the first rows; none where a required column is missing."""
    table = cells(data)
    for at, row in enumerate(table[:HEADER_ROWS]):
        names = {HEADERS[x.strip()]: i for i, x in reversed(list(enumerate(row))) if x.strip() in HEADERS}
        if {"question_id", "question_text"} <= set(names):
            break
    else:
        return []
    if not set(REQUIRED) <= set(names):
        return []
    out = []
    for row in table[at + 1 :]:
        value = {n: row[i].strip() if i < len(row) else "" for n, i in names.items()}
        if value["question_text"]:
            tags = [x.strip() for x in re.split(r"[,，、;；|]", value["knowledge_tags"]) if x.strip()]
            out.append({**value, "knowledge_tags": tags, **{k: value.get(k) or v for k, v in DEFAULTS.items()}})
    return out


def _binary(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, chapter, section, text): blocks between headings of the Word files of a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, i, *block) for f, data in zip(batch["file"], batch["content"]) for i, block in enumerate(sections(bytes(data)))]
            yield pd.DataFrame(rows, columns=["source", "block", "chapter", "section", "text"])

    return _binary(spark, path, "docx").mapInPandas(run, "source string, block int, chapter string, section string, text string")


def read_xlsx_bank(spark: SparkSession, path: str) -> DataFrame:
    """The questions of the spreadsheets of a folder."""
    columns = [c.split()[0] for c in BANK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"file": f, **q} for f, data in zip(batch["file"], batch["content"]) for q in bank_rows(bytes(data))]
            yield pd.DataFrame(rows, columns=columns)

    return _binary(spark, path, "xlsx").mapInPandas(run, BANK)


def attachment_text(name: str, data: bytes) -> str:
    """The text of an attachment within its bounds: Word and text files, and the first rows of a sheet; others have none."""
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix == "docx":
        text = "\n".join(t for _, t in paragraphs(data))
    elif suffix == "xlsx":
        text = "\n".join("\t".join(row) for row in cells(data, ROWS, COLUMNS))
    elif suffix in ("txt", "md", "csv", "json"):
        text = data.decode("utf-8", "replace")
    else:
        text = ""
    return text[:CHARS]


def attachment_pictures(name: str, data: bytes, most: int = 6) -> list[str]:
    """The names of the pictures in a Word file or spreadsheet, in order, without those that are too large."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            inside = [x for x in archive.infolist() if x.filename.startswith(("word/media/", "xl/media/")) and 0 < x.file_size <= PICTURE_BYTES]
    except zipfile.BadZipFile:
        return []
    return sorted(x.filename for x in inside)[:most]


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, pictures) of all files of a folder."""
    rows = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = list(zip(batch["file"], map(bytes, batch["content"])))
            yield pd.DataFrame({"file": [f for f, _ in pairs], "text": [attachment_text(f, d) for f, d in pairs], "pictures": [attachment_pictures(f, d) for f, d in pairs]})

    return rows.mapInPandas(run, "file string, text string, pictures array<string>")
