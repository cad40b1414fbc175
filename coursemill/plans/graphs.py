"""Queries of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.operators import graph, insights
from coursemill.plans import tables as t
from coursemill.plans.registry import query

_H = "substr(sha1({}), 1, 16)"
_DOC = "'document:' || " + _H.format("source")
_PAGE = "'page:' || " + _H.format("source || '|' || page_start")
_CONCEPT = "'concept:' || " + _H.format("lower(name)")
_COMP = "'component:' || " + _H.format("chunk_id || '|' || component")
_NET = "'net:' || " + _H.format("chunk_id || '|' || net")
_PARTS = (
    t.MENTIONS
    + """, comp AS (SELECT id AS chunk_id, x.id AS component, x.terminals AS terminals FROM (SELECT id, unnest(multimodal.components) AS x FROM c) WHERE x.id IS NOT NULL),
    net AS (SELECT id AS chunk_id, x.id AS net, x.terminals AS terminals FROM (SELECT id, unnest(multimodal.nets) AS x FROM c) WHERE x.id IS NOT NULL),
    wired AS (SELECT DISTINCT chunk_id, net, component FROM (
        SELECT n.chunk_id, n.net, regexp_extract(n.t, '^([^.:/]+)', 1) AS component FROM (SELECT chunk_id, net, unnest(terminals) AS t FROM net) n
        WHERE (n.chunk_id, regexp_extract(n.t, '^([^.:/]+)', 1)) IN (SELECT chunk_id, component FROM comp)
        UNION ALL SELECT p.chunk_id, p.t AS net, p.component FROM (SELECT chunk_id, component, unnest(terminals) AS t FROM comp) p WHERE (p.chunk_id, p.t) IN (SELECT chunk_id, net FROM net)))"""
)
_NODES = f"""nodes AS (SELECT DISTINCT {_DOC} AS id, 'document' AS type, source AS name FROM c WHERE source IS NOT NULL
    UNION SELECT {_PAGE}, 'page', source || ' p.' || page_start FROM c WHERE source IS NOT NULL AND page_start IS NOT NULL
    UNION SELECT id, 'chunk', coalesce(section, '') FROM c UNION SELECT {_CONCEPT}, 'concept', lower(name) FROM mentions
    UNION SELECT {_COMP}, 'component', component FROM comp UNION SELECT {_NET}, 'net', net FROM net)"""
_EDGES = f"""edges AS (SELECT DISTINCT {_DOC} AS source, 'HAS_PAGE' AS type, {_PAGE} AS target FROM c WHERE source IS NOT NULL AND page_start IS NOT NULL
    UNION SELECT {_PAGE}, 'HAS_CHUNK', id FROM c WHERE source IS NOT NULL AND page_start IS NOT NULL UNION SELECT chunk_id, 'MENTIONS', {_CONCEPT} FROM mentions
    UNION SELECT chunk_id, 'CONTAINS', {_COMP} FROM comp UNION SELECT {_NET}, 'CONNECTED_TO', {_COMP} FROM wired)"""
_COVERS = "cov AS (SELECT c.source, c.page_start AS page, lower(m.name) AS concept, count(DISTINCT m.chunk_id) AS evidence FROM c JOIN mentions m ON m.chunk_id = c.id WHERE c.source IS NOT NULL AND c.page_start IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_PARTS}, {_NODES} SELECT id, type, name FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents, pages, chunks, concepts, components and nets."""
    return graph.nodes(t.chunks(spark, d))


@query(f"WITH {_PARTS}, {_EDGES} SELECT source, type, target FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """What has, mentions, contains and connects what."""
    return graph.edges(t.chunks(spark, d))


@query(f"WITH {_PARTS}, {_NODES}, {_EDGES} SELECT count(*) AS edges, count(*) FILTER (source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)) AS dangling FROM edges")
def graph_dangling(spark: SparkSession, d: str) -> DataFrame:
    """The number of edges, and of those with an end that is no node."""
    c = t.chunks(spark, d)
    e = graph.edges(c)
    return e.agg(F.count("*").alias("edges")).crossJoin(graph.dangling(graph.nodes(c), e).agg(F.count("*").alias("dangling")))


@query(f"WITH {t.MENTIONS}, {_COVERS} SELECT source, page, concept, evidence FROM cov")
def graph_projection(spark: SparkSession, d: str) -> DataFrame:
    """The student's view: pages that cover concepts, with evidence."""
    return graph.covers(t.chunks(spark, d))


@query(f"WITH {_PARTS}, {_EDGES} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    """Edges at every node."""
    return graph.degrees(graph.edges(t.chunks(spark, d)))


@query(f"WITH {t.MENTIONS}, {_COVERS} SELECT source, page, sum(evidence)::BIGINT AS coverage, count(*) AS concepts FROM cov GROUP BY source, page ORDER BY coverage DESC, source, page LIMIT 24")
def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The 24 pages with most evidence of concepts (a top-k report)."""
    return graph.page_coverage(graph.covers(t.chunks(spark, d)), 24)


@query(f"WITH {_PARTS}, {_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_totals(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each type."""
    return graph.node_totals(graph.nodes(t.chunks(spark, d)))


@query(f"WITH {_PARTS} SELECT chunk_id, net, component FROM wired")
def net_connections(spark: SparkSession, d: str) -> DataFrame:
    """Nets and the components they reach."""
    return graph.connections(t.chunks(spark, d))


_MARKER = "regexp_extract(coalesce(chapter, ''), '^(第[0-9一二三四五六七八九十]+章|Chapter [0-9]+)', 1) <> ''"


@query(
    f"""WITH {t.MENTIONS}, rows AS (SELECT * FROM c WHERE {_MARKER}),
    k AS (SELECT chapter, count(DISTINCT lower(name)) AS concepts FROM rows JOIN mentions ON chunk_id = id GROUP BY chapter),
    per AS (SELECT chapter, min(least(page_start, page_end)) AS page_start, max(greatest(page_start, page_end)) AS page_end,
      count(DISTINCT CASE WHEN source IS NOT NULL AND page_start IS NOT NULL THEN (source, page_start) END) AS pages, count(DISTINCT source) AS sources, count(DISTINCT nullif(coalesce(section, ''), '')) AS sections FROM rows GROUP BY chapter)
    SELECT per.*, coalesce(concepts, 0) AS concepts FROM per LEFT JOIN k USING (chapter)"""
)
def chapter_summary(spark: SparkSession, d: str) -> DataFrame:
    """Pages, sources, sections and concepts of every chapter."""
    return graph.chapter_summaries(t.chunks(spark, d))


_CHAPTER_CONCEPTS = f"""cc AS (SELECT chapter, lower(name) AS concept, count(DISTINCT id) AS evidence FROM c JOIN mentions ON chunk_id = id WHERE {_MARKER} GROUP BY chapter, lower(name)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY evidence DESC, concept) AS rank FROM cc)"""


@query(f"WITH {t.MENTIONS}, {_CHAPTER_CONCEPTS} SELECT chapter, concept, evidence, rank FROM ranked WHERE rank <= 10")
def chapter_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The ten main concepts of every chapter."""
    return graph.chapter_concepts(t.chunks(spark, d), 10)



@query(
    f"""WITH {t.MENTIONS}, {_CHAPTER_CONCEPTS}, ord AS (SELECT chapter, CASE WHEN chapter LIKE 'Chapter%' THEN 1000 ELSE 0 END + CAST(regexp_extract(chapter, '([0-9]+)', 1) AS INTEGER) AS position FROM (SELECT DISTINCT chapter FROM c WHERE regexp_matches(chapter, '^(第[0-9]+章|Chapter [0-9]+)')))
    SELECT a.chapter, r.concept AS prerequisite, r.rank FROM ord a JOIN ord b ON b.position + 1 = a.position JOIN ranked r ON r.chapter = b.chapter WHERE r.rank <= 3"""
)
def prerequisites(spark: SparkSession, d: str) -> DataFrame:
    """The main concepts of the chapter before each chapter."""
    c = t.chunks(spark, d)
    number = F.regexp_extract("chapter", "([0-9]+)", 1).cast("int")
    order = c.select("chapter").where(F.col("chapter").rlike("^(第[0-9]+章|Chapter [0-9]+)")).distinct()
    order = order.withColumn("position", F.when(F.startswith("chapter", F.lit("Chapter")), 1000).otherwise(0) + number)
    return insights.prerequisites(order, graph.chapter_concepts(c, 10))
