"""A knowledge base from pages and elements: clean, chunk, tag, graph, summarise, check, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions import circuits
from coursemill.functions import text as T
from coursemill.operators import chunking, cleaning, graph, quality
from coursemill.session import materialize
from coursemill.sources.store import VersionedStore


#: Schema of the parts of a circuit in a chunk.
PARTS = "struct<components:array<struct<id:string,type:string,terminals:array<string>>>,nets:array<struct<id:string,terminals:array<string>>>>"


def verified(elements: DataFrame) -> DataFrame:
    """Elements in which a circuit that is not plausible by its parts, confidence and words is an image without parts."""
    words = F.lower(F.concat_ws("\n", "caption", F.substring("description", 1, 180)))
    refused = (F.col("element_type") == "circuit") & ~circuits.is_circuit(F.col("components"), F.col("confidence"), words)
    values = {"element_type": F.lit("image"), "components": F.lit(None), "nets": F.lit(None), "netlist": F.lit("")}
    return elements.withColumns({c: F.when(refused, x).otherwise(F.col(c)) for c, x in values.items()})


def build_chunks(pages: DataFrame, elements: DataFrame, concepts: list[str]) -> DataFrame:
    """Chunks of the cleaned pages and of the elements, tagged with the concepts they name.

    pages has page_id, source, page, chapter, section, text; elements has the columns of layout_elements.
    Circuits that are not plausible become images; the parts of the others are in multimodal, null for all else.
    """
    cleaned = cleaning.clean_pages(pages)
    facts = pages.select("page_id", "source", "page", "chapter", "section")
    packed = chunking.chunk_pages(facts.join(cleaned.withColumnRenamed("cleaned", "text"), "page_id")).join(facts, "page_id")
    text = packed.select("id", "text", "source", "chapter", "section", F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.lit("text").alias("element_type"))
    text = text.withColumn("multimodal", F.lit(None).cast(PARTS))
    parts = F.when((F.size("components") > 0) | (F.size("nets") > 0), F.struct("components", "nets")).cast(PARTS)
    columns = ["id", "text", "source", "chapter", "section", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "element_type"]
    drawn = chunking.multimodal_chunks(verified(elements)).select(*columns, parts.alias("multimodal"))
    rows = text.unionByName(drawn).dropDuplicates(["id"])
    return rows.withColumn("doc_type", F.lit("textbook")).withColumn("knowledge_tags", T.contained(concepts, F.concat_ws(" ", "section", "text")))


def build(pages: DataFrame, elements: DataFrame, concepts: list[str]) -> dict[str, DataFrame]:
    """The tables of a knowledge base: chunks, nodes, edges, chapters, audit."""
    chunks = materialize(build_chunks(pages, elements, concepts), "chunks")
    nodes, edges = graph.nodes(chunks), graph.edges(chunks)
    rules = {
        "chunk has text": F.length(F.trim("text")) > 0,
        "chunk is no question": F.coalesce("doc_type", F.lit("")) != "question",
        "chunk is within the limit": F.length("text") <= chunking.LIMIT + 20,  # with the blank lines between paragraphs
        "chunk has a page": F.col("page_start") >= 1,
    }
    loose = graph.dangling(nodes, edges).agg(F.lit("edge has both ends").alias("rule"), F.count("*").alias("failed")).crossJoin(edges.agg(F.count("*").alias("total"))).withColumn("ok", F.col("failed") == 0)
    audit = quality.expect(chunks, rules).unionByName(loose)
    return {"chunks": chunks, "nodes": nodes, "edges": edges, "chapters": graph.chapter_summaries(chunks), "audit": audit}


def publish(store: VersionedStore, tables: dict[str, DataFrame], required: tuple[str, ...] = ("chunk has text", "edge has both ends")) -> str:
    """Make the tables the current version of a store; raises where a required rule of the audit fails."""
    failed = [r.rule for r in tables["audit"].where(~F.col("ok")).collect() if r.rule in required]
    if failed:
        raise ValueError(f"not published: {', '.join(failed)}")
    return store.publish(tables, {"chunks": ["element_type"]})
