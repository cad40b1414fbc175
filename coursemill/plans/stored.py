"""Queries that write to a store and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.operators import graph
from coursemill.plans import tables as t
from coursemill.plans.registry import query
from coursemill.session import read_table, shared_dir
from coursemill.sources import collections, files
from coursemill.sources.store import VersionedStore


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/coursemill-{name}-{uuid.uuid4().hex}"


@query("SELECT DISTINCT id, text, source, chapter, section, page_start, page_end, doc_type, array_to_string(coalesce(knowledge_tags, []), '|') AS tags FROM text_chunks")
def chunk_log(spark: SparkSession, d: str) -> DataFrame:
    """All chunks written as lines of JSON and read again."""
    at = _place(spark, "log")
    files.write_jsonl(read_table(spark, d, "text_chunks").select("id", "text", "source", "chapter", "section", "page_start", "page_end", "doc_type", "knowledge_tags", "element_type").distinct(), at)
    tags = F.array_join(F.coalesce("knowledge_tags", F.array().cast("array<string>")), "|")
    return files.read_chunks(spark, at).select("id", "text", "source", "chapter", "section", "page_start", "page_end", "doc_type", tags.alias("tags"))


@query("SELECT question_code AS question_id, text AS question_text, array_to_string(coalesce(knowledge_tags, []), '|') AS tags, coalesce(standard_answer, '') AS standard_answer, coalesce(difficulty, '基础') AS difficulty, question_type FROM eval_items WHERE trim(text) <> ''")
def question_bank(spark: SparkSession, d: str) -> DataFrame:
    """The bank written as objects of JSON with a list of questions each, and read again."""
    at = _place(spark, "bank")
    items = read_table(spark, d, "eval_items").select((F.col("item_id") % 8).alias("part"), F.struct(F.col("question_code").alias("question_id"), F.col("text").alias("question_text"), "knowledge_tags", "standard_answer", "difficulty", "question_type").alias("q"))
    packed = items.groupBy("part").agg(F.to_json(F.struct(F.collect_list("q").alias("questions"))).alias("value"))
    packed.select("value", "part").write.partitionBy("part").text(at)
    rows = files.read_question_bank(spark, at)
    return rows.select("question_id", "question_text", F.array_join("knowledge_tags", "|").alias("tags"), "standard_answer", "difficulty", "question_type")


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))), 1e-12), 4))[1] AS first, round(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))), 1e-12), 4) AS size FROM embeddings")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written at length one, twice over and beside those of another collection, and read again."""
    at, rows = _place(spark, "vectors"), read_table(spark, d, "embeddings").select("vec_id", "embedding")
    for name in ("other", "main", "main"):
        collections.write_vectors(rows, at, "vec_id", "embedding", name)
    collections.drop_collection(spark, at, "other")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return spark.read.parquet(at).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"), F.round(norm, 4).alias("size"))


@query(
    f"""WITH {t.CHUNKS}, {t.MENTIONS[len(t.CHUNKS) + 2 :]}, p AS (SELECT id, unnest(multimodal.components) AS x FROM c), n AS (SELECT id, unnest(multimodal.nets) AS x FROM c)
    SELECT 'document' AS type, count(DISTINCT source) AS n FROM c UNION ALL SELECT 'page', count(*) FROM (SELECT DISTINCT source, page_start FROM c WHERE source IS NOT NULL AND page_start IS NOT NULL) UNION ALL SELECT 'chunk', count(*) FROM c
    UNION ALL SELECT 'concept', count(DISTINCT lower(name)) FROM mentions UNION ALL SELECT 'component', count(*) FROM (SELECT DISTINCT id, x.id AS part FROM p WHERE x.id IS NOT NULL) UNION ALL SELECT 'net', count(*) FROM (SELECT DISTINCT id, x.id AS part FROM n WHERE x.id IS NOT NULL)"""
)
def graph_store(spark: SparkSession, d: str) -> DataFrame:
    """The graph written for two collections and anew for one, and the nodes of that one by type."""
    at, chunks = _place(spark, "graph"), t.chunks(spark, d)
    nodes, edges = graph.nodes(chunks), graph.edges(chunks)
    collections.write_graph(nodes, edges, at, "other")
    collections.write_graph(nodes.limit(0), edges.limit(0), at, "main")
    collections.write_graph(nodes, edges, at, "main")
    return graph.node_totals(spark.read.parquet(f"{at}/nodes").where("collection = 'main'"))


@query(f"WITH {t.MESSAGES} SELECT session_id, seq, role, content FROM log WHERE session_id = (SELECT min(session_id) FROM log)")
def session_file(spark: SparkSession, d: str) -> DataFrame:
    """The messages of one session from a store of all."""
    at, log = _place(spark, "sessions"), t.message_log(spark, d).select("session_id", "seq", "role", "content")
    collections.write_sessions(log, at)
    first = log.agg(F.min("session_id")).first()[0] or ""
    return collections.read_session(spark, at, first).select("session_id", "seq", "role", "content")


@query(f"WITH {t.MESSAGES} SELECT sha256(session_id) AS digest, session_id, epoch_us(max(created_at)) AS updated_at FROM log GROUP BY session_id")
def session_index(spark: SparkSession, d: str) -> DataFrame:
    """Where each session is found, and when it was used last."""
    return collections.session_index(t.message_log(spark, d)).withColumn("updated_at", F.unix_micros(F.col("updated_at").cast("timestamp")))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 = 1")
def state_file(spark: SparkSession, d: str) -> DataFrame:
    """Lists of JSON written by user, beside a broken file, and read again."""
    at = _place(spark, "state")
    rows = read_table(spark, d, "events").where("event_id % 10 = 1").select((F.col("event_id") % 64).alias("part"), F.struct("event_id", "user_id", "event_type").alias("s"))
    lists = rows.groupBy("part").agg(F.to_json(F.collect_list("s")).alias("value")).unionByName(spark.createDataFrame([(-1, "{broken")], "part long, value string"))
    lists.write.partitionBy("part").text(at)
    return collections.read_state(spark, at, "event_id long, user_id long, event_type string")


@query(
    """SELECT source, page, page_id, text FROM page_documents WHERE source IS NOT NULL AND page IS NOT NULL AND trim(text, ' ') <> '' AND coalesce(doc_type, '') <> ''
    QUALIFY row_number() OVER (PARTITION BY source, page ORDER BY page_id DESC) = 1"""
)
def recognised_pages(spark: SparkSession, d: str) -> DataFrame:
    """The last text of every page in a cache of which only some rows fit."""
    rows = read_table(spark, d, "page_documents").where("source IS NOT NULL AND page IS NOT NULL").select("source", "page", "page_id", "text", F.when(F.coalesce("doc_type", F.lit("")) != "", 2).otherwise(1).alias("schema_version"), F.lit("m").alias("model"))
    return collections.recognised_pages(rows.distinct(), ["source", "page"], "page_id", 2, "m").select("source", "page", "page_id", "text")


@query("SELECT 'current' AS version, count(*) AS n FROM (SELECT DISTINCT id FROM layout_elements) UNION ALL SELECT 'before', count(*) FROM (SELECT DISTINCT id FROM layout_elements WHERE element_type = 'circuit')")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """How many elements the current version of a store has, and how many the one before after a rollback."""
    store, ids = VersionedStore(spark, _place(spark, "store")), read_table(spark, d, "layout_elements").select("id", "element_type").distinct()
    store.publish({"elements": ids.where("element_type = 'circuit'")})
    store.publish({"elements": ids})
    now = store.read("elements").agg(F.lit("current").alias("version"), F.countDistinct("id").alias("n"))
    store.rollback()
    return now.unionByName(store.read("elements").agg(F.lit("before").alias("version"), F.countDistinct("id").alias("n")))
