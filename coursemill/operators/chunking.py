"""Chunks of pages, of layout elements and of questions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions import text as T

LIMIT, OVERLAP = 900, 140


def sentence_pieces(text: str, limit: int = LIMIT) -> list[str]:
    """A paragraph as pieces of at most limit characters: packed sentences; a longer sentence is sliced."""
    if len(text) <= limit:
        return [text] if text else []
    pieces, buffer = [], ""
    for sentence in re.findall(r"[^。！？；]*[。！？；]|[^。！？；]+$", text):
        if len(buffer) + len(sentence) <= limit:
            buffer += sentence
            continue
        if buffer:
            pieces.append(buffer)
        while len(sentence) > limit:
            pieces.append(sentence[:limit])
            sentence = sentence[limit:]
        buffer = sentence
    return [*pieces, buffer] if buffer else pieces


def pack(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """Chunks of a page: paragraphs joined by blank lines up to limit, the end of a flushed chunk repeated where it fits."""
    pieces = [p for paragraph in re.split(r"\n\s*\n", text) for p in sentence_pieces(paragraph.strip(), limit)]
    chunks: list[str] = []
    held: list[str] = []
    for piece in pieces:
        if held and sum(map(len, held)) + len(piece) > limit:
            done = "\n\n".join(held)
            chunks.append(done)
            held = [done[-overlap:]] if len(done) > overlap and overlap + len(piece) <= limit else []
        held.append(piece)
    return [*chunks, "\n\n".join(held)] if held else chunks


def chunk_pages(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(page_id, chunk_no, id, text): the chunks of every page; blank pages have none.

    id is the short hash of source, page, section and the first 120 characters, so two chunks
    of a page that begin alike share it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*row[:4], n, chunk) for row in batch.itertuples(index=False) for n, chunk in enumerate(pack(row.text, limit, overlap), 1)]
            yield pd.DataFrame(out, columns=["page_id", "source", "page", "section", "chunk_no", "text"]).astype({"page": "Int32"})

    rows = pages.where("trim(text) <> ''").select("page_id", "source", F.col("page").cast("int").alias("page"), "section", "text")
    packed = rows.mapInPandas(run, "page_id string, source string, page int, section string, chunk_no int, text string")
    return with_chunk_ids(packed).select("page_id", "chunk_no", "id", "text")


def with_chunk_ids(rows: DataFrame) -> DataFrame:
    """rows with id: the first 16 hex digits of the SHA-1 of source|page|section|text[:120]."""
    return rows.withColumn("id", T.short_hash("source", "page", "section", F.substring("text", 1, 120)))


def element_chunks(elements: DataFrame) -> DataFrame:
    """Layout elements with text that are worth a chunk, each content once.

    Text elements are covered by their pages.  Two keys of sameness: the content hash, and the
    first 500 characters without blanks in lower case; the smallest id stays.
    """
    rows = elements.where("element_type <> 'text' AND trim(text) <> ''")
    rows = rows.withColumn("_same", F.substring(F.regexp_replace(F.lower("text"), r"[ \t\n]+", ""), 1, 500))
    first = F.row_number().over(Window.partitionBy(F.coalesce("content_hash", F.concat(F.lit("id:"), "id"))).orderBy("id"))
    rows = rows.withColumn("_n", first).where("_n = 1")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_same").orderBy("id"))).where("_n = 1")
    return rows.drop("_n", "_same")


def _quoted(c: Column) -> Column:
    """A string as JSON, null as null."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def _json(items: Column, *fields: str) -> Column:
    """Components or nets as JSON with a blank after commas and colons; null and no items give null."""

    def entry(x: Column) -> Column:
        ends = F.coalesce(_listed(F.transform(x["terminals"], _quoted)), F.lit("null"))
        parts = [F.concat(F.lit(f'"{f}": '), _quoted(x[f])) for f in fields]
        whole = F.concat(F.lit("{"), F.concat_ws(", ", *parts, F.concat(F.lit('"terminals": '), ends)), F.lit("}"))
        return F.when(x.isNull(), F.lit("null")).otherwise(whole)

    return F.when(F.size(items) > 0, _listed(F.transform(items, entry)))


#: What counts as a blank: Unicode white space and the separators of ASCII.
_BLANK = r"[\s\x1C-\x1F]"


def element_text(caption: Column, text: Column, description: Column, components: Column, nets: Column, netlist: Column) -> Column:
    """All that an element says, a line or more each: caption, text, description, components, nets, netlist; empty where it says nothing."""
    parts = [caption, text, description, F.concat(F.lit("元件："), _json(components, "id", "type")), F.concat(F.lit("连接网络："), _json(nets, "id"))]
    parts.append(F.concat(F.lit("Netlist：\n"), F.nullif(netlist, F.lit(""))))
    body = F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])
    return F.regexp_replace(body, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def multimodal_chunks(elements: DataFrame) -> DataFrame:
    """Layout elements that say anything, with element_text as their text, each content of a page and kind once.

    Text elements are covered by their pages.  Two keys of sameness, both within source, page and
    element_type: the content hash (none where it is null or empty), and the first 500 characters
    without blanks in lower case, there by the printed page where it is known; the smallest id stays.
    """
    columns = ["caption", "text", "description", "components", "nets", "netlist"]
    rows = elements.where(~F.col("element_type").eqNullSafe("text")).withColumn("text", element_text(*[F.col(c) for c in columns]))
    same = F.coalesce(F.concat(F.lit("hash:"), F.nullif("content_hash", F.lit(""))), F.concat(F.lit("id:"), "id"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source", "page", "element_type", same).orderBy("id"))).where("_n = 1 AND text <> ''")
    printed = F.coalesce(F.nullif("source_page", F.lit(0)), "page")
    begin = F.substring(F.lower(F.regexp_replace("text", rf"(?U){_BLANK}+", "")), 1, 500)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("source", printed, "element_type", begin).orderBy("id"))).where("_n = 1").drop("_n")


def question_chunks(questions: DataFrame) -> DataFrame:
    """(id, text, doc_type, knowledge_tags): questions as hidden chunks."""
    parts = [F.concat(F.lit("题目："), "text"), F.concat(F.lit("标准答案："), "standard_answer"), F.concat(F.lit("难度："), F.coalesce("difficulty", F.lit("基础")))]
    return questions.select(F.concat(F.lit("question-"), F.col("item_id").cast("string")).alias("id"), F.concat_ws("\n", *parts).alias("text"), F.lit("question").alias("doc_type"), "knowledge_tags")


def embedding_text(*parts: str) -> Column:
    """Non-empty parts joined by line ends."""
    return F.array_join(F.filter(F.array(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), lambda x: x != ""), "\n")
