"""The entities of the engine from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import text as T
from coursemill.operators import graph, sessions
from coursemill.session import read_table

#: Searches take as queries every row whose id is divisible by this.
EVERY = 50


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "page_documents").drop("extracted_at", "ingested_at", "bbox", "extra").distinct()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, questions left out, once each."""
    return graph.distinct_chunks(read_table(spark, d, "text_chunks"))


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, doc_type, words, tags): all chunks once each, with what a search looks at."""
    rows = read_table(spark, d, "text_chunks").select("id", "doc_type", "chapter", "section", "knowledge_tags", "text").distinct()
    tags = F.array_join(F.coalesce("knowledge_tags", F.array().cast("array<string>")), " ")
    return rows.select("id", "doc_type", T.search_text("chapter", "section", tags, "text").alias("words"), tags.alias("tags"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query): the questions that are searched for."""
    return read_table(spark, d, "eval_items").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query): the requests whose words are looked up in the graph."""
    rows = requests(spark, d).where(F.col("request_id") % EVERY == 0)
    return rows.select(F.col("request_id").alias("query_id"), F.coalesce("question", F.lit("")).alias("query"))


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Layout elements once each, with the components and nets of circuits."""
    return read_table(spark, d, "layout_elements").drop("extracted_at", "ingested_at").distinct()


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Layout elements once each, for queries that look at no part of a circuit."""
    return read_table(spark, d, "layout_elements").drop("extracted_at", "ingested_at", "components", "nets").distinct()


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests once each; second deliveries differ in arrival only."""
    return read_table(spark, d, "mistake_requests").drop("received_at", "attachment_ids").dropDuplicates(["request_id"])


def request_questions(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, question): what every request asks, content where question is blank."""
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    return requests(spark, d).select("request_id", F.when(blank, F.col("content")).otherwise(F.col("question")).alias("question"))


def mistakes(spark: SparkSession, d: str) -> DataFrame:
    """(student_id, request_id, source, agent, tags): requests with the tags of their question in the bank."""
    bank = read_table(spark, d, "eval_items").select(F.col("question_code").alias("question_bank_id"), F.col("knowledge_tags").alias("tags"))
    rows = requests(spark, d).select("student_id", "request_id", "source", "agent", "question_bank_id")
    return rows.join(bank, "question_bank_id")


def message_log(spark: SparkSession, d: str) -> DataFrame:
    return sessions.messages(requests(spark, d))


#: SQL of the same entities.
CHUNKS = "c AS (SELECT DISTINCT ON (id) id, source, chapter, section, page_start, page_end, doc_type, knowledge_tags, element_type, multimodal FROM text_chunks WHERE doc_type IS NULL OR doc_type <> 'question')"
CHUNK_TEXTS = "ct AS (SELECT DISTINCT id, doc_type, concat_ws(' ', chapter, section, array_to_string(coalesce(knowledge_tags, []), ' '), text) AS words, array_to_string(coalesce(knowledge_tags, []), ' ') AS tags FROM text_chunks)"
QUESTIONS = "q AS (SELECT item_id AS query_id, text AS query FROM eval_items WHERE item_id % 50 = 0)"
REQUESTS = "r AS (SELECT DISTINCT ON (request_id) * EXCLUDE (received_at) FROM mistake_requests)"
ASKED = REQUESTS + ", q AS (SELECT request_id AS query_id, coalesce(question, '') AS query FROM r WHERE request_id % 50 = 0)"
MESSAGES = (
    REQUESTS
    + """, m0 AS (SELECT session_id, request_id, created_at, unnest(messages) AS m, generate_subscripts(messages, 1) AS pos FROM r WHERE session_id IS NOT NULL),
    log AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, request_id, pos) AS seq, m.role AS role, m.content AS content, created_at FROM m0)"""
)
MENTIONS = (
    CHUNKS
    + r""", mentions AS (SELECT chunk_id, name FROM (SELECT id AS chunk_id, unnest(list_distinct(list_transform(knowledge_tags, lambda x: trim(regexp_replace(x, '^[0-9]+(\.[0-9]+)*[ \t]*', ''))))) AS name FROM c) WHERE name <> '')"""
)
MISTAKES = REQUESTS + ", mistakes AS (SELECT r.student_id, r.request_id, r.source, r.agent, e.knowledge_tags AS tags FROM r JOIN eval_items e ON e.question_code = r.question_bank_id)"
