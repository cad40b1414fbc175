"""Ranking: BM25, exact vector similarity, overlap, min-max fusion and the visual lane.

Queries are a small table; it is broadcast behind a check of its size (operators.joins).  The
corpus is never shuffled whole: only the terms of the queries survive the first stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from coursemill.functions import text as T
from coursemill.operators.joins import guarded_join
from coursemill.session import materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
LENGTH = "\x00length "
#: The words of the queries are looked up inside the texts up to so many, beyond that they are joined.
TERMS = 20_000
#: The weights of the signals of a hybrid search without and with query images.
WEIGHTS = {"vector": 0.34, "bm25": 0.24, "token_overlap": 0.08, "tag_overlap": 0.08, "graph": 0.10, "cross": 0.10, "image": 0.06}
IMAGE_WEIGHTS = {"vector": 0.24, "bm25": 0.16, "token_overlap": 0.06, "tag_overlap": 0.06, "graph": 0.08, "cross": 0.10, "image": 0.30}
VISUAL_LEAST, VISUAL_PINS = 0.70, 2
#: Query vectors that are broadcast at once, and rows that are multiplied with them at once.
QUERY_BLOCK, ROW_BLOCK = 5_000, 1_000


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def bm25_scores(corpus: DataFrame, queries: DataFrame, key: str, query_key: str, text: str = "text", query_text: str = "query") -> DataFrame:
    """(query_key, key, score) of every pair with a common term, by Okapi BM25.

    Negative inverse frequencies become EPSILON times the mean over the vocabulary.  A term
    repeated in the query counts as often.  Null and empty texts match nothing, but count as
    documents.
    """
    # one pass over the corpus: the frequencies, and for each length, under a term that no text has, the number of texts
    seen = T.let(T.tokens(text), lambda w: F.array_append(F.array_distinct(w), F.concat(F.lit(LENGTH), F.size(w).cast("string"))))
    counted = materialize(corpus.select(F.explode(seen).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    lengths = counted.where(F.startswith("term", F.lit(LENGTH))).select("df", F.substring("term", len(LENGTH) + 1, 20).cast("bigint").alias("dl"))
    facts = lengths.agg(F.sum("df").alias("n"), (F.sum(F.col("df") * F.col("dl")) / F.sum("df")).alias("avgdl"))
    frequency = counted.where(~F.startswith("term", F.lit(LENGTH))).select("term", "df")
    idf = frequency.crossJoin(F.broadcast(facts)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("raw").alias("mean"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select(F.col(query_key), F.explode(T.tokens(query_text)).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("times"))
    asked = asked.join(idf, "term")
    asked = materialize(asked, "asked")
    postings = _postings(corpus, asked, key, text).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    hits = guarded_join(postings, asked, ["term"]).crossJoin(F.broadcast(facts))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(query_key, key).agg(F.sum(part).alias("score"))


def _postings(corpus: DataFrame, asked: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, term): the tokens of the texts that are asked for, with the number of all tokens of their text."""
    names = [r.term for r in asked.select("term").distinct().limit(TERMS + 1).collect()]  # at most TERMS + 1 words
    keep = (lambda x: x.isin(names)) if len(names) <= TERMS else (lambda x: F.lit(True))
    kept = T.let(T.tokens(text), lambda w: T.let(F.size(w), lambda n: F.transform(F.filter(w, keep), lambda x: F.struct(x.alias("term"), n.alias("dl")))))
    postings = corpus.select(key, F.explode(kept).alias("p")).select(key, "p.dl", "p.term")
    return postings if len(names) <= TERMS else guarded_join(postings, asked.select("term").distinct(), ["term"], "left_semi")


def bm25_topk(corpus: DataFrame, queries: DataFrame, key: str, query_key: str, k: int = 6, hidden: Column | None = None, **names: str) -> DataFrame:
    """(query_key, key, score, rank): the k best rows; rows where hidden holds take part in the statistics only."""
    scores = bm25_scores(corpus, queries, key, query_key, **names).withColumn("score", F.round("score", 4))
    if hidden is not None:
        scores = scores.join(corpus.where(~hidden).select(key), key, "left_semi")
    return top_k(scores, query_key, [F.desc("score"), F.asc(key)], k).select(query_key, key, "score", F.col("rank").cast("bigint").alias("rank"))


def cosine_pairs(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", least: float = -2.0, k: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_key, key, score): exact cosine, rounded to six places, of every row with every query, where it is at least least.

    With k only rows that may be among the k nearest of a query are returned (ties with the last one included).
    The queries are taken in blocks of block, each broadcast as a matrix and multiplied with batches of
    rows.  Rows and queries without a vector have score 0 with all, and so have vectors of different lengths.
    """
    spark = vectors.sparkSession
    schema = StructType([StructField(query_key, queries.schema[query_key].dataType), StructField(key, vectors.schema[key].dataType), StructField("score", DoubleType())])
    rows = vectors.select(key, F.col(vector).alias("v"))
    asked = ((r[0], r[1] or []) for r in queries.select(query_key, vector).toLocalIterator())
    results = []
    while part := list(islice(asked, block)):
        shared = spark.sparkContext.broadcast(([q for q, _ in part], [np.array(v, np.float64) for _, v in part]))
        results.append(rows.mapInArrow(partial(_cosine_kernel, shared, to_arrow_schema(schema), least, k), schema))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], schema)


def _cosine_kernel(shared, schema: pa.Schema, least: float, k: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, matrix = shared.value
    size = max(map(len, matrix), default=0)
    widths = np.array([len(v) for v in matrix])
    asked = np.stack([np.pad(v, (0, size - len(v))) for v in matrix]) if matrix else np.zeros((0, 0))
    asked /= np.maximum(np.sqrt((asked * asked).sum(1)), 1e-12)[:, None]
    for whole in batches:
        for first in range(0, whole.num_rows, ROW_BLOCK):
            batch = whole.slice(first, ROW_BLOCK)
            column = batch.column(1)
            width = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not column.null_count and (width == size).all():
                rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            else:
                rows = np.zeros((len(width), size))
                for at, v in enumerate(column.to_pylist()):
                    rows[at, : min(len(v or []), size)] = (v or [])[:size]
            rows = rows / np.maximum(np.sqrt((rows * rows).sum(1)), 1e-12)[:, None]
            score = np.round(np.where(width[:, None] == widths[None, :], rows @ asked.T, 0.0), 6) + 0.0
            keep = score >= least
            if k is not None and len(width) > k:
                keep &= score >= np.partition(score, -k, axis=0)[-k]
            at, query = np.nonzero(keep)
            columns = [pa.array(names, schema.field(0).type).take(pa.array(query)), batch.column(0).take(pa.array(at)), pa.array(score[at, query])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 6, **names: str) -> DataFrame:
    """(query_id, vec_id, score, rank): the k rows nearest by cosine; ties go by the smaller key."""
    key, query_key = names.get("key", "vec_id"), names.get("query_key", "query_id")
    scores = cosine_pairs(vectors, queries, k=k, **names)
    return top_k(scores, query_key, [F.desc("score"), F.asc(key)], k).select(query_key, key, "score", F.col("rank").cast("bigint").alias("rank"))


def min_max(score: str, group: str) -> Column:
    """The score between 0 and 1 within its group; equal scores become 1 if positive, else 0."""
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-12, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((F.col(score) - low) / (high - low))


def candidates(k: int) -> int:
    """How many rows the vector, BM25 and image signals each bring forward for k results."""
    return max(4 * k, 16)


def hybrid(rows: DataFrame, queries: DataFrame, signals: dict[str, DataFrame], key: str, query_key: str, cross: Callable[[Column, Column], Column], k: int = 6) -> DataFrame:
    """(query_key, key, score, rank): the k best rows by all signals together.

    rows has key, words, tags (texts); queries has query_key, query.  signals are vector, bm25, graph,
    image and visual as (query_key, key, score), each cut to its candidates before (graph is not);
    a row is looked at if any of them has it.  Word and tag overlap and the cross score, a function of the
    query and the words, are taken of these rows only.  vector, bm25, image, visual and cross are brought to
    0..1 among a query's own candidates.  A query with visual rows (of its picture) uses IMAGE_WEIGHTS, and its
    first VISUAL_PINS visual rows go first.  Ties go by key.
    """
    parts = [df.select(query_key, key, F.lit(name).alias("signal"), F.col("score").alias("raw"), (F.col("score") if name == "graph" else min_max("score", query_key)).alias("value")) for name, df in signals.items()]
    union = reduce(DataFrame.unionByName, parts)
    of = lambda name, column: F.max(F.when(F.col("signal") == name, F.col(column)))
    found = union.groupBy(query_key, key).agg(*[F.coalesce(of(name, "value"), F.lit(0.0)).alias(name) for name in ("vector", "bm25", "graph", "image")], of("visual", "raw").alias("seen"), F.coalesce(of("visual", "value"), F.lit(0.0)).alias("visual"))
    found = guarded_join(rows, materialize(found, "candidates"), [key])
    found = guarded_join(found, queries.select(query_key, "query"), [query_key])
    words = T.tokens("query")
    found = found.withColumn("token_overlap", T.overlap(words, T.tokens("words"))).withColumn("tag_overlap", T.overlap(words, T.tokens("tags"))).withColumn("_cross", F.round(cross(F.col("query"), F.col("words")), 6))
    found = found.withColumn("cross", min_max("_cross", query_key)).withColumn("pictured", F.max(F.col("seen").isNotNull()).over(Window.partitionBy(query_key)))
    total = lambda weights: sum((F.col(c) * weights[n] for n, c in [*((n, n) for n in WEIGHTS if n != "image"), ("image", "visual" if weights is IMAGE_WEIGHTS else "image")]), F.lit(0.0))
    found = found.withColumn("score", F.round(F.when(F.col("pictured"), total(IMAGE_WEIGHTS)).otherwise(total(WEIGHTS)), 4))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc_nulls_last("seen"), key))
    found = found.withColumn("pin", F.when(F.col("seen").isNotNull() & (place <= VISUAL_PINS), place).otherwise(VISUAL_PINS + 1))
    return top_k(found, query_key, [F.asc("pin"), F.desc("score"), F.asc(key)], k).select(query_key, key, "score", F.col("rank").cast("bigint").alias("rank"))


def overlaps(rows: DataFrame, queries: DataFrame, key: str, query_key: str, words: Column, query_words: Column, least: float = 0.0) -> DataFrame:
    """(query_key, key, score): part of the query's distinct words that stand among the row's words, where over least."""
    asked = queries.select(query_key, F.array_distinct(query_words).alias("asked")).select(query_key, F.size("asked").alias("size"), F.explode("asked").alias("word"))
    have = rows.select(key, F.explode(F.array_distinct(words)).alias("word"))
    hits = guarded_join(have, asked, ["word"]).groupBy(query_key, key, "size").agg(F.count("*").alias("n"))
    return hits.select(query_key, key, (F.col("n") / F.greatest(F.col("size"), F.lit(1))).alias("score")).where(F.col("score") > least)


def graph_matches(concepts: DataFrame, mentions: DataFrame, queries: DataFrame, query_key: str, query_text: str = "query") -> DataFrame:
    """(query_key, chunk_id): chunks that mention a concept named in the query.

    concepts has name; mentions has name, chunk_id.  A name matches where the query contains it.
    The names are few (an ontology) and looked up in the broadcast query texts.
    """
    asked = queries.select(query_key, F.lower(query_text).alias("asked"))
    named = concepts.select("name", F.lower("name").alias("low")).where(F.length("name") > 1)
    matched = named.join(F.broadcast(asked), F.contains(F.col("asked"), F.col("low"))).select(query_key, "name")
    return guarded_join(mentions, matched, ["name"]).select(query_key, "chunk_id").distinct()


def visual_lane(scores: DataFrame, text: DataFrame, query_key: str, key: str, k: int = 6) -> DataFrame:
    """(query_key, key, score, rank): up to two images of at least 0.70 first, then the text results."""
    best = scores.groupBy(query_key, key).agg(F.max("score").alias("score")).where(F.col("score") >= VISUAL_LEAST)
    pinned = top_k(best, query_key, [F.desc("score"), F.asc(key)], VISUAL_PINS).select(query_key, key, "score", F.lit(0).alias("lane"))
    rest = text.join(pinned.select(query_key, key), [query_key, key], "left_anti").select(query_key, key, "score", F.lit(1).alias("lane"))
    return top_k(pinned.unionByName(rest), query_key, [F.asc("lane"), F.desc("score"), F.asc(key)], k).select(query_key, key, "score", F.col("rank").cast("bigint").alias("rank"))
