"""Queries of search and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import text as T
from coursemill.operators import chunking, fuzzy, search
from coursemill.operators.joins import guarded_join
from coursemill.plans import tables as t
from coursemill.plans.registry import query
from coursemill.session import read_table

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_]+|[一-鿿]')"


def _bm25(corpus: str, key: str, text: str) -> str:
    """CTEs that end in scores(query_id, key, score) over a corpus."""
    return f"""
    w AS (SELECT {key} AS key, {_TOKENS.format(f"coalesce({text}, '')")} AS words FROM {corpus}),
    facts AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w),
    post AS (SELECT key, len(words) AS dl, unnest(words) AS term FROM w),
    dfs AS (SELECT term, count(DISTINCT key) AS df FROM post GROUP BY term),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, facts),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.format("query")}) AS term FROM q) GROUP BY query_id, term),
    tf AS (SELECT key, dl, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM asked) GROUP BY key, dl, term),
    scores AS (SELECT query_id, key, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 4) AS score
               FROM tf JOIN asked USING (term) JOIN idf USING (term), facts GROUP BY query_id, key)"""


@query(
    f"WITH {t.QUESTIONS}, {_bm25('documents', 'doc_id', 'text')}"
    " SELECT query_id, key AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scores QUALIFY rank <= 6"
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The documents that match each question best."""
    return search.bm25_topk(read_table(spark, d, "documents").select("doc_id", "text"), t.questions(spark, d), "doc_id", "query_id")


@query(
    f"""WITH {t.QUESTIONS}, corpus AS (SELECT DISTINCT id, coalesce(doc_type, '') AS doc_type, text FROM text_chunks
        UNION ALL SELECT 'question-' || item_id, 'question', concat_ws(chr(10), '题目：' || text, '标准答案：' || standard_answer, '难度：' || coalesce(difficulty, '基础')) FROM eval_items),
    {_bm25("corpus", "id", "text")}
    SELECT query_id, key AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank
    FROM scores WHERE key NOT IN (SELECT id FROM corpus WHERE doc_type = 'question') QUALIFY rank <= 6"""
)
def search_isolated(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that match each question best; questions of the bank count in the statistics, but are never shown."""
    rows = read_table(spark, d, "text_chunks").select("id", F.coalesce("doc_type", F.lit("")).alias("doc_type"), "text").distinct()
    corpus = rows.unionByName(chunking.question_chunks(read_table(spark, d, "eval_items")).select("id", "doc_type", "text"))
    return search.bm25_topk(corpus, t.questions(spark, d), "id", "query_id", hidden=F.col("doc_type") == "question")


_COSINE = """
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0),
    cos AS (SELECT query_id, vec_id, list_cosine_similarity(e, qe) AS score FROM v, qv)"""


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").where(F.col("vec_id") % t.EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {_COSINE} SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM cos QUALIFY rank <= 6")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The vectors nearest to each query vector, exactly."""
    return search.vector_topk(read_table(spark, d, "embeddings").select("vec_id", "embedding"), _vector_queries(spark, d))


@query(
    f"""WITH {_COSINE}, top AS (SELECT query_id, vec_id, round(score, 6) AS score FROM cos QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) <= 16)
    SELECT query_id, vec_id, round((score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)), 4) AS score FROM top"""
)
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    """The scores of the 16 nearest vectors of each query between 0 and 1."""
    top = search.vector_topk(read_table(spark, d, "embeddings").select("vec_id", "embedding"), _vector_queries(spark, d), k=16)
    return top.select("query_id", "vec_id", F.round(search.min_max("score", "query_id"), 4).alias("score"))


_OVERLAP = f"""
    qt AS (SELECT query_id, list_distinct({_TOKENS.format("query")}) AS qt FROM q),
    cw AS (SELECT id, list_distinct({_TOKENS.format("words")}) AS w, list_distinct({_TOKENS.format("tags")}) AS g FROM ct WHERE doc_type IS NULL OR doc_type <> 'question'),
    ov AS (SELECT query_id, id, len(list_intersect(qt, w)) / greatest(1, len(qt)) AS words, len(list_intersect(qt, g)) / greatest(1, len(qt)) AS tags FROM qt, cw)"""


@query(f"WITH {t.QUESTIONS}, {t.CHUNK_TEXTS}, {_OVERLAP} SELECT query_id, id, round(words, 4) AS score FROM ov WHERE words > 0.5")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold more than half of the distinct words of a question."""
    rows = t.chunk_texts(spark, d).where("doc_type IS NULL OR doc_type <> 'question'")
    out = search.overlaps(rows, t.questions(spark, d), "id", "query_id", T.tokens("words"), T.tokens("query"), 0.5)
    return out.withColumn("score", F.round("score", 4))


_GRAPH = """
    named AS (SELECT DISTINCT name FROM mentions WHERE length(name) > 1),
    gm AS (SELECT DISTINCT query_id, chunk_id FROM q JOIN named ON contains(lower(query), lower(named.name)) JOIN mentions USING (name))"""


@query(f"WITH {t.ASKED}, {t.MENTIONS}, {_GRAPH} SELECT query_id, chunk_id FROM gm")
def graph_theta_match(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that mention a concept which a question names."""
    from coursemill.operators import graph

    mentions = graph.mentions(t.chunks(spark, d))
    return search.graph_matches(mentions.select("name").distinct(), mentions, t.asked(spark, d), "query_id")


# The tables hold no vectors of chunks: each chunk takes those of two rows of embeddings by parts of its id, and each question two by its own.
# Every second question comes with a picture.

_NORM = "CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN CASE WHEN max(score) OVER w > 0 THEN 1.0 ELSE 0.0 END ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
_SUM = lambda weights, image: " + ".join(f"{weights[n]}::DOUBLE * {c}" for n, c in (("vector", "vector"), ("bm25", "bm25"), ("token_overlap", "words"), ("tag_overlap", "tags"), ("graph", "graph"), ("cross", "crossed"), ("image", image)))
_HYBRID = f"""
    {t.QUESTIONS}, {t.CHUNK_TEXTS}, shown AS (SELECT * FROM ct WHERE doc_type IS NULL OR doc_type <> 'question'), {_bm25("shown", "id", "words")}, {t.MENTIONS}, {_GRAPH},
    size AS (SELECT count(*) AS size FROM embeddings), kinds AS (SELECT DISTINCT id, element_type FROM text_chunks),
    placed AS (SELECT id, ('0x' || substr(id, 1, 6))::BIGINT % size AS vec, ('0x' || substr(id, 7, 6))::BIGINT % size AS pic, element_type IN ('circuit', 'image') AS drawn FROM shown JOIN kinds USING (id), size),
    qv AS (SELECT query_id, query_id % size AS vec, (query_id + 1) % size AS pic, query_id % 100 = 0 AS pictured FROM q, size),
    vec AS (SELECT query_id, id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM placed p JOIN embeddings a ON a.vec_id = p.vec, qv JOIN embeddings b ON b.vec_id = qv.vec
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 24),
    img AS (SELECT query_id, id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM placed p JOIN embeddings a ON a.vec_id = p.pic, qv JOIN embeddings b ON b.vec_id = qv.vec WHERE p.drawn
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 24),
    vis AS (SELECT query_id, id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM placed p JOIN embeddings a ON a.vec_id = p.pic, qv JOIN embeddings b ON b.vec_id = qv.pic WHERE p.drawn AND qv.pictured
            QUALIFY score >= 0.7 AND row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 24),
    bm AS (SELECT query_id, key AS id, score FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) <= 24),
    u AS (SELECT query_id, id, 'vector' AS signal, score AS raw, {_NORM} AS value FROM vec WINDOW w AS (PARTITION BY query_id) UNION ALL
          SELECT query_id, id, 'bm25', score, {_NORM} FROM bm WINDOW w AS (PARTITION BY query_id) UNION ALL SELECT query_id, id, 'image', score, {_NORM} FROM img WINDOW w AS (PARTITION BY query_id) UNION ALL
          SELECT query_id, id, 'visual', score, {_NORM} FROM vis WINDOW w AS (PARTITION BY query_id) UNION ALL SELECT query_id, chunk_id, 'graph', 1.0, 1.0 FROM gm),
    cand AS (SELECT query_id, id, coalesce(max(value) FILTER (signal = 'vector'), 0) AS vector, coalesce(max(value) FILTER (signal = 'bm25'), 0) AS bm25, coalesce(max(value) FILTER (signal = 'graph'), 0) AS graph,
          coalesce(max(value) FILTER (signal = 'image'), 0) AS image, max(raw) FILTER (signal = 'visual') AS seen, coalesce(max(value) FILTER (signal = 'visual'), 0) AS visual FROM u GROUP BY query_id, id),
    tk AS (SELECT cand.*, list_distinct({_TOKENS.format("query")}) AS qt, list_distinct({_TOKENS.format("words")}) AS wt, list_distinct({_TOKENS.format("tags")}) AS gt FROM cand JOIN shown USING (id) JOIN q USING (query_id)),
    x AS (SELECT *, len(list_intersect(qt, wt)) / greatest(1, len(qt)) AS words, len(list_intersect(qt, gt)) / greatest(1, len(qt)) AS tags, round(len(list_intersect(qt, wt)) / greatest(1, len(list_distinct(qt || wt))), 6) AS score FROM tk),
    y AS (SELECT *, {_NORM} AS crossed, count(seen) OVER w > 0 AS pictured, row_number() OVER (PARTITION BY query_id ORDER BY seen DESC NULLS LAST, id) AS place FROM x WINDOW w AS (PARTITION BY query_id)),
    z AS (SELECT query_id, id, round(CASE WHEN pictured THEN {_SUM(search.IMAGE_WEIGHTS, "visual")} ELSE {_SUM(search.WEIGHTS, "image")} END, 4) AS score, CASE WHEN seen IS NOT NULL AND place <= 2 THEN place ELSE 3 END AS pin FROM y)"""


def jaccard(query: Column, words: Column) -> Column:
    """Common part of the distinct tokens of two texts: the scorer that stands in for a cross-encoder."""
    return T.let(T.tokens(words), lambda w: F.size(F.array_intersect(T.tokens(query), w)) / F.greatest(F.lit(1), F.size(F.array_union(T.tokens(query), w))))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    from coursemill.operators import graph

    rows, asked = t.chunk_texts(spark, d).where("doc_type IS NULL OR doc_type <> 'question'"), t.questions(spark, d)
    vectors = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    size = vectors.count()
    part = lambda at: (F.conv(F.substring("id", at, 6), 16, 10).cast("bigint") % size).alias("vec_id")
    chunks = t.chunks(spark, d).select("id", "element_type")
    with_vector = chunks.select("id", part(1)).join(vectors, "vec_id").select("id", "embedding")
    with_picture = chunks.where("element_type IN ('circuit', 'image')").select("id", part(7)).join(vectors, "vec_id").select("id", "embedding")
    of = lambda step: asked.select("query_id", ((F.col("query_id") + step) % size).alias("vec_id")).join(vectors, "vec_id").select("query_id", "embedding")
    most = search.candidates(6)
    mentions = graph.mentions(t.chunks(spark, d))
    nearest = lambda have, want: search.vector_topk(have, want, k=most, key="id")
    signals = {
        "vector": nearest(with_vector, of(0)),
        "bm25": search.bm25_topk(rows, asked, "id", "query_id", k=most, text="words"),
        "graph": search.graph_matches(mentions.select("name").distinct(), mentions, asked, "query_id").select("query_id", F.col("chunk_id").alias("id"), F.lit(1.0).alias("score")),
        "image": nearest(with_picture, of(0)),
        "visual": nearest(with_picture, of(1).where("query_id % 100 = 0")).where(F.col("score") >= search.VISUAL_LEAST),
    }
    return search.hybrid(rows, asked, signals, "id", "query_id", jaccard)


@query(f"WITH {_HYBRID} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY pin, score DESC, id) AS rank FROM z QUALIFY rank <= 6")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks for each question by all seven signals: vectors, BM25, word and tag overlap, graph, cross scores and images."""
    return _hybrid(spark, d)


_WORDS = _bm25("documents", "doc_id", "text")


@query(
    f"""WITH {_COSINE}, {t.QUESTIONS}, {_WORDS}, img AS (SELECT 1000 + 50 * label AS query_id, cos.vec_id, max(round(score, 6)) AS score FROM cos JOIN embeddings e ON e.vec_id = cos.query_id GROUP BY label, cos.vec_id),
    pin AS (SELECT query_id, vec_id, score, 0 AS lane FROM img WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 2),
    u AS (SELECT * FROM pin UNION ALL SELECT query_id, key, score, 1 FROM scores WHERE (query_id, key) NOT IN (SELECT query_id, vec_id FROM pin))
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY lane, score DESC, vec_id) AS rank FROM u QUALIFY rank <= 6"""
)
def visual_lane(spark: SparkSession, d: str) -> DataFrame:
    """Up to two alike images first, then the documents that match the question best; the images of one label are asked together, with the question of that number."""
    vectors = read_table(spark, d, "embeddings")
    labels = vectors.where(F.col("vec_id") % t.EVERY == 0).select(F.col("vec_id").alias("image"), (1000 + 50 * F.col("label")).cast("bigint").alias("query_id"))
    pairs = search.cosine_pairs(vectors.select("vec_id", "embedding"), _vector_queries(spark, d).withColumnRenamed("query_id", "image"), query_key="image", least=search.VISUAL_LEAST)
    scores = guarded_join(pairs, labels, ["image"]).select("query_id", "vec_id", "score")
    text = search.bm25_topk(read_table(spark, d, "documents").select("doc_id", "text"), t.questions(spark, d), "doc_id", "query_id", k=6 + search.VISUAL_PINS)
    return search.visual_lane(scores, text.select("query_id", F.col("doc_id").alias("vec_id"), "score"), "query_id", "vec_id")


@query()
def near_dup_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of requests that are almost the same, with the class of each; a request with nothing to compare is a class of its own."""
    rows = t.request_questions(spark, d)
    found = rows.select("request_id").join(fuzzy.near_duplicates(rows, "request_id", "question"), "request_id", "left")
    return found.select("request_id", F.coalesce("class_id", "request_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


@query()
def tag_match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Words of OCR concepts matched to the names of the ontology, exactly or nearly."""
    points = read_table(spark, d, "page_documents").select(F.explode("extra.ocr_concepts").alias("point")).union(read_table(spark, d, "text_chunks").select(T.meaningful_section("section")))
    names = read_table(spark, d, "text_chunks").select(F.explode("knowledge_tags").alias("name"))
    return fuzzy.match_names(points.where("point <> ''"), names)


@query(
    """WITH p AS (SELECT DISTINCT unnest(extra.ocr_concepts) AS point FROM page_documents), n AS (SELECT DISTINCT unnest(knowledge_tags) AS name FROM text_chunks),
    pk AS (SELECT point, regexp_replace(lower(point), '[^0-9a-z一-鿿]+', '', 'g') AS low FROM p WHERE point IS NOT NULL), nk AS (SELECT min(name) AS name, regexp_replace(lower(name), '[^0-9a-z一-鿿]+', '', 'g') AS low FROM n GROUP BY 2)
    SELECT point, name FROM pk JOIN nk USING (low)"""
)
def tag_match_exact(spark: SparkSession, d: str) -> DataFrame:
    """OCR concepts that equal a name of the ontology."""
    p = read_table(spark, d, "page_documents").select(F.explode("extra.ocr_concepts").alias("point")).where("point IS NOT NULL").distinct().withColumn("low", T.comparison_text("point"))
    n = read_table(spark, d, "text_chunks").select(F.explode("knowledge_tags").alias("name")).groupBy(T.comparison_text("name").alias("low")).agg(F.min("name").alias("name"))
    return p.join(n, "low").select("point", "name")
