"""The property graph of a collection as two tables, nodes and edges, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions import text as T

#: The longest list of concepts of one chunk.
CONCEPTS = 12


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without second deliveries, questions left out; the smallest arrival of an id stays."""
    columns = ["id", "source", "chapter", "section", "page_start", "page_end", "doc_type", "knowledge_tags", "element_type", "multimodal"]
    return chunks.where("doc_type IS NULL OR doc_type <> 'question'").select(*columns).dropDuplicates(["id"])


def mentions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, name): the concepts of every chunk, normalised, each once, at most CONCEPTS in their order."""
    names = F.transform(F.coalesce("knowledge_tags", F.array().cast("array<string>")), lambda x: T.normalize_concept(x))
    names = F.slice(F.array_distinct(F.filter(names, lambda x: x != "")), 1, CONCEPTS)
    return chunks.select(F.col("id").alias("chunk_id"), F.explode(names).alias("name"))


def node_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), T.short_hash(*parts))


def nodes(chunks: DataFrame) -> DataFrame:
    """(id, type, name): documents, pages, chunks, concepts, components and nets, each once."""
    sources = chunks.where("source IS NOT NULL").select(node_id("document", F.col("source")).alias("id"), F.lit("document").alias("type"), F.col("source").alias("name"))
    paged = chunks.where("source IS NOT NULL AND page_start IS NOT NULL")
    pages = paged.select(node_id("page", F.col("source"), F.col("page_start")).alias("id"), F.lit("page").alias("type"), F.concat_ws(" p.", "source", F.col("page_start").cast("string")).alias("name"))
    rows = chunks.select(F.col("id"), F.lit("chunk").alias("type"), F.coalesce("section", F.lit("")).alias("name"))
    concepts = mentions(chunks).select(node_id("concept", F.lower("name")).alias("id"), F.lit("concept").alias("type"), F.lower("name").alias("name"))
    parts = components(chunks).select(node_id("component", F.col("chunk_id"), F.col("component")).alias("id"), F.lit("component").alias("type"), F.col("component").alias("name"))
    wires = nets(chunks).select(node_id("net", F.col("chunk_id"), F.col("net")).alias("id"), F.lit("net").alias("type"), F.col("net").alias("name"))
    return sources.union(pages).union(rows).union(concepts).union(parts).union(wires).distinct()


def components(chunks: DataFrame) -> DataFrame:
    """(chunk_id, component, kind, terminals) of the circuits."""
    c = chunks.select(F.col("id").alias("chunk_id"), F.explode("multimodal.components").alias("c"))
    return c.select("chunk_id", F.col("c.id").alias("component"), F.col("c.type").alias("kind"), F.col("c.terminals").alias("terminals")).where("component IS NOT NULL")


def nets(chunks: DataFrame) -> DataFrame:
    """(chunk_id, net, terminals) of the circuits."""
    n = chunks.select(F.col("id").alias("chunk_id"), F.explode("multimodal.nets").alias("n"))
    return n.select("chunk_id", F.col("n.id").alias("net"), F.col("n.terminals").alias("terminals")).where("net IS NOT NULL")


def connections(chunks: DataFrame) -> DataFrame:
    """(chunk_id, net, component): a net reaches a component by the prefix of its terminals, or by the component's own terminals."""
    by_net = nets(chunks).select("chunk_id", "net", F.explode("terminals").alias("t")).select("chunk_id", "net", F.regexp_extract("t", r"^([^.:/]+)", 1).alias("component"))
    known = components(chunks).select("chunk_id", "component")
    by_net = by_net.join(known, ["chunk_id", "component"], "left_semi")
    by_part = components(chunks).select("chunk_id", "component", F.explode("terminals").alias("net")).join(nets(chunks).select("chunk_id", "net"), ["chunk_id", "net"], "left_semi")
    return by_net.select("chunk_id", "net", "component").union(by_part.select("chunk_id", "net", "component")).distinct()


def edges(chunks: DataFrame) -> DataFrame:
    """(source, type, target): HAS_PAGE, HAS_CHUNK, MENTIONS, CONTAINS and CONNECTED_TO, each once."""
    paged = chunks.where("source IS NOT NULL AND page_start IS NOT NULL")
    page = node_id("page", F.col("source"), F.col("page_start"))
    out = paged.select(node_id("document", F.col("source")).alias("source"), F.lit("HAS_PAGE").alias("type"), page.alias("target"))
    out = out.union(paged.select(page, F.lit("HAS_CHUNK"), F.col("id")))
    out = out.union(mentions(chunks).select("chunk_id", F.lit("MENTIONS"), node_id("concept", F.lower("name"))))
    out = out.union(components(chunks).select("chunk_id", F.lit("CONTAINS"), node_id("component", F.col("chunk_id"), F.col("component"))))
    wired = connections(chunks)
    out = out.union(wired.select(node_id("net", F.col("chunk_id"), F.col("net")), F.lit("CONNECTED_TO"), node_id("component", F.col("chunk_id"), F.col("component"))))
    return out.distinct()


def dangling(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Edges with an end that is no node: the source or the target."""
    known = node_table.select("id")
    return edge_table.join(known.withColumnRenamed("id", "source"), "source", "left_anti").unionByName(edge_table.join(known.withColumnRenamed("id", "target"), "target", "left_anti")).distinct()


def degrees(edge_table: DataFrame) -> DataFrame:
    """(id, degree): edges at either end."""
    ends = edge_table.select(F.col("source").alias("id")).unionByName(edge_table.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def covers(chunks: DataFrame) -> DataFrame:
    """(source, page, concept, evidence): the student's view, where pages cover the concepts of their chunks."""
    paged = chunks.where("source IS NOT NULL AND page_start IS NOT NULL").select(F.col("id").alias("chunk_id"), "source", F.col("page_start").alias("page"))
    named = mentions(chunks).select("chunk_id", F.lower("name").alias("concept")).distinct()
    return paged.join(named, "chunk_id").groupBy("source", "page", "concept").agg(F.count("*").alias("evidence"))


def page_coverage(covered: DataFrame, k: int) -> DataFrame:
    """(source, page, coverage, concepts): the k pages with most evidence; ties go by source and page."""
    per = covered.groupBy("source", "page").agg(F.sum("evidence").alias("coverage"), F.count("*").alias("concepts"))
    return per.orderBy(F.desc("coverage"), "source", "page").limit(k)


def chapter_summaries(chunks: DataFrame) -> DataFrame:
    """(chapter, page_start, page_end, pages, sources, sections, concepts): per chapter with a marker.

    Swapped and missing page ranges count by what is there.
    """
    rows = chunks.where(T.chapter_marker("chapter") != "")
    names = mentions(rows).select(F.col("chunk_id").alias("id"), F.lower("name").alias("concept"))
    concept_counts = rows.select("id", "chapter").join(names, "id").groupBy("chapter").agg(F.countDistinct("concept").alias("concepts"))
    per = rows.groupBy("chapter").agg(
        F.min(F.least("page_start", "page_end")).alias("page_start"),
        F.max(F.greatest("page_start", "page_end")).alias("page_end"),
        F.countDistinct("source", "page_start").alias("pages"),
        F.countDistinct("source").alias("sources"),
        F.countDistinct(F.when(F.coalesce("section", F.lit("")) != "", F.col("section"))).alias("sections"),
    )
    return per.join(concept_counts, "chapter", "left").withColumn("concepts", F.coalesce("concepts", F.lit(0)))


def chapter_concepts(chunks: DataFrame, k: int) -> DataFrame:
    """(chapter, concept, evidence, rank): the k concepts of each chapter with most chunks; ties go by name."""
    rows = chunks.where(T.chapter_marker("chapter") != "").select("id", "chapter")
    names = mentions(chunks).select(F.col("chunk_id").alias("id"), F.lower("name").alias("concept")).distinct()
    counted = rows.join(names, "id").groupBy("chapter", "concept").agg(F.count("*").alias("evidence"))
    rank = F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("evidence"), "concept"))
    return counted.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def node_totals(node_table: DataFrame) -> DataFrame:
    """(type, n)."""
    return node_table.groupBy("type").agg(F.count("*").alias("n"))
