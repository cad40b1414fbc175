"""Reading course material: folders, Markdown and text, JSON banks and layouts, chunk logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What is indexed, and what is a question bank and stays out of the index.
INDEXED = ("pdf", "md", "txt", "docx")
BANKS = ("xlsx", "json")

PAGE = "text string, source string, page int, chapter string, section string, doc_type string"
QUESTION = "question_id string, question_text string, knowledge_tags array<string>, standard_answer string, difficulty string, question_type string"
ELEMENT = "id string, type string, page int, page_idx int, bbox array<double>, text string, caption string"
CHUNK = "id string, text string, source string, chapter string, section string, page_start int, page_end int, doc_type string, knowledge_tags array<string>, element_type string"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source, suffix, length, use): the files of a folder; use is index, bank or other. Contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    rows = files.withColumn("source", F.element_at(F.split("path", "/"), -1)).withColumn("suffix", F.lower(F.regexp_extract("source", r"\.([A-Za-z0-9]+)$", 1)))
    use = F.when(F.col("suffix").isin(*INDEXED), "index").when(F.col("suffix").isin(*BANKS), "bank").otherwise("other")
    return rows.withColumn("use", use)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, chapter, section, text): blocks between headings of Markdown or text files.

    A first-level heading sets chapter and section, deeper ones (to level 3) the section; blank
    blocks are left out.
    """
    lines = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.posexplode(F.split("value", r"\r?\n", -1)).alias("at", "line"))
    level, title = F.length(F.regexp_extract("line", r"^(#{1,3}) +\S", 1)), F.trim(F.regexp_extract("line", r"^#{1,3} +(.*)$", 1))
    w = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("level", level).withColumn("title", title).withColumn("block", F.sum((F.col("level") > 0).cast("int")).over(w))
    marked = marked.withColumn("chapter", F.last(F.when(F.col("level") == 1, F.col("title")), True).over(w)).withColumn("section", F.last(F.when(F.col("level") > 0, F.col("title")), True).over(w))
    body = marked.where("level = 0").groupBy("source", "block", "chapter", "section").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    out = body.withColumn("text", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")).where("text <> ''")
    return out.select("source", F.col("block").cast("int").alias("block"), "chapter", "section", "text")


def read_question_bank(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON files (a list, or an object with questions), defaults filled in, ids by position where missing.

    Files that are no JSON give no rows.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    as_list = F.from_json("value", f"array<struct<{QUESTION.replace(' ', ':').replace(',:', ', ')}>>")
    inner = F.from_json("value", f"questions array<struct<{QUESTION.replace(' ', ':').replace(',:', ', ')}>>")["questions"]
    rows = raw.select("file", F.posexplode(F.when(F.startswith("value", F.lit("[")), as_list).otherwise(inner)).alias("at", "q")).where("q IS NOT NULL")
    q = lambda c, d: F.coalesce(F.col(f"q.{c}"), F.lit(d)).alias(c)
    return rows.where("trim(q.question_text) <> ''").select(
        F.coalesce("q.question_id", F.format_string("JSON-%03d", F.col("at") + 1)).alias("question_id"), "q.question_text", F.coalesce("q.knowledge_tags", F.array().cast("array<string>")).alias("knowledge_tags"),
        q("standard_answer", ""), q("difficulty", "基础"), q("question_type", "综合题"),
    )


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, element_type, bbox, text, reading_order) of external layout files; empty texts are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.trim("value").alias("value"))
    element = f"array<struct<{ELEMENT.replace(' ', ':').replace(',:', ', ')}>>"
    listed = F.when(F.startswith("value", F.lit("[")), F.from_json("value", element)).otherwise(F.coalesce(F.from_json("value", f"elements {element}")["elements"], F.from_json("value", f"content_list {element}")["content_list"]))
    rows = raw.select("source", F.posexplode(listed).alias("at", "e")).where("trim(e.text) <> ''")
    kind = F.when(F.col("e.type") == "equation", "formula").otherwise(F.coalesce("e.type", F.lit("text")))
    return rows.select("source", F.coalesce("e.page", F.col("e.page_idx") + 1).alias("page"), kind.alias("element_type"), "e.bbox", "e.text", (100_000 + F.col("at")).alias("reading_order"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON-lines log; blank and broken lines are left out."""
    return spark.read.schema(CHUNK).json(path, mode="DROPMALFORMED").where("id IS NOT NULL")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown_lines(pages: DataFrame) -> DataFrame:
    """(source, page, line): pages as Markdown, with a heading where chapter or section changes."""
    w = Window.partitionBy("source").orderBy("page", "page_id")
    changed = lambda c: (F.coalesce(c, F.lit("")) != F.coalesce(F.lag(c).over(w), F.lit(""))) & (F.coalesce(c, F.lit("")) != "")
    chapter, section = F.when(changed("chapter"), F.concat(F.lit("## "), "chapter")), F.when(changed("section"), F.concat(F.lit("### "), "section"))
    parts = F.array_compact(F.array(chapter, section, F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->")), F.col("text")))
    return pages.select("source", "page", F.array_join(parts, "\n").alias("line"))
