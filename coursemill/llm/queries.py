"""The queries of the training-data problems, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm import answers, canonical, leakage, packing, residue, scans, site_lines, splitting, sql
from coursemill.session import read_table

KEYS = {"page_documents": "page_id", "text_chunks": "id", "layout_elements": "id"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows of one table whose texts look the same but differ."""
    parts = [
        canonical.lookalike_pairs(read_table(spark, d, t).select(KEYS[t], "text"), KEYS[t]).select(F.lit(t).alias("tbl"), "key_a", "key_b")
        for t in ("page_documents", "text_chunks")
    ]
    return parts[0].unionByName(parts[1])


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Rows that look the same as another of different characters, with their class and the number of such others."""
    parts = [
        canonical.lookalike_classes(read_table(spark, d, t).select(KEYS[t], "text"), KEYS[t]).select(F.lit(t).alias("tbl"), "row_key", F.lower(F.hex("form")).alias("class_id"), "links")
        for t in ("page_documents", "text_chunks")
    ]
    return parts[0].unionByName(parts[1])


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every page and chunk in the consistent form, once a row."""
    parts = [
        canonical.canonical_texts(read_table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(KEYS[t]).alias("row_key"), "text"))
        for t in ("page_documents", "text_chunks")
    ]
    both = parts[0].unionByName(parts[1])
    return both.select("tbl", "row_key", "canonical", (F.col("text") != F.col("canonical")).alias("changed")).dropDuplicates(["tbl", "row_key"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized chunks and whether they can be cut at natural boundaries alone."""
    return splitting.split_items(read_table(spark, d, "text_chunks")).select("id", "cut").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the oversized chunks."""
    return splitting.split_items(read_table(spark, d, "text_chunks"))


def _scan_rows(spark: SparkSession, d: str) -> DataFrame:
    return scans.page_rows(*(read_table(spark, d, t) for t in ("page_documents", "layout_elements", "source_files")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages and layout elements with noise of scanning, and its kinds."""
    return scans.find_noise(_scan_rows(spark, d))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every page and layout element as continuous paragraphs without that noise."""
    return scans.repair_texts(_scan_rows(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose answer is no usable answer, with the defect."""
    return answers.find_defects(read_table(spark, d, "mistake_requests").select("request_id", "question", "content", "answer"))


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    """All labels of the requests whose posteriors pass the cutoffs."""
    return answers.label_defects(read_table(spark, d, "mistake_requests").select("request_id", "question", "content", "answer"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines repeated excessively within their source, counted over three partitions by arrival."""
    index = site_lines.SiteLines(spark)
    for part in site_lines.arrival_parts(read_table(spark, d, "page_documents").select("page_id", "source", "text", "ingested_at")):
        index.merge(part)
    return index.found()


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page without its repeated lines, after three partitions by arrival of which each rebuilds only what it changes."""
    clean = site_lines.CleanPages(site_lines.SiteLines(spark))
    for part in site_lines.arrival_parts(read_table(spark, d, "page_documents").select("page_id", "source", "text", "ingested_at")):
        clean.merge(part)
    return clean.pages()


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its container, for every target."""
    return packing.pack(read_table(spark, d, "documents").select("doc_id", "text"), read_table(spark, d, "pack_targets"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of every target are."""
    return packing.fill_report(p6_packing(spark, d), read_table(spark, d, "pack_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry evaluation items."""
    return leakage.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue of templates, filler, error messages or demands for scripts."""
    return residue.find_residue(read_table(spark, d, "documents"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay when those are excluded."""
    documents = read_table(spark, d, "documents")
    return residue.without_residue(documents, residue.find_residue(documents)).select("doc_id", "lang", "source", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_classes, p1_texts, p2_found, p2_pieces, p3_found, p3_texts, p4_found, p4_labels, p5_found, p5_pages, p6_packing, p6_fill, p7_found, p8_found, p8_kept)
}
ORACLE_SQL: dict[str, str] = {
    "p1_found": sql.p1_sql(),
    "p5_found": sql.p5_sql(),
    "p2_found": rf"""
        WITH big AS (SELECT DISTINCT id, regexp_replace(text, '(?i)\b({"|".join(re.escape(a) for a in splitting.ABBREVIATIONS)})\.', '\1,', 'g') AS text FROM text_chunks WHERE length(text) > 900),
        parts AS (SELECT id, unnest(regexp_split_to_array(text, '\n|[。！？!?]+|\.(\s|$)')) AS part FROM big)
        SELECT id, CASE WHEN max(length(part)) > 898 THEN 'forced' ELSE 'natural' END AS cut FROM parts GROUP BY id
    """,
}
