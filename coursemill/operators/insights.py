"""Weak areas and alignment of learners' mistakes to chapters, by counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.operators.joins import guarded_join


def score(n: Column, sources: Column) -> Column:
    """10 a mistake, 5 for each repeat, 2 for each further source."""
    return 10 * n + 5 * F.greatest(n - 1, F.lit(0)) + 2 * F.greatest(sources - 1, F.lit(0))


def severity(value: Column) -> Column:
    return F.when(value >= 35, "severe").when(value >= 20, "medium").otherwise("light")


def weak_areas(mistakes: DataFrame, top: int = 6) -> DataFrame:
    """(student_id, tag, n, sources, score, severity, priority): the top areas of every student.

    mistakes has student_id, source, tags (array).  A mistake counts once for each distinct tag;
    null tags and students are left out.  Ties go by name.
    """
    rows = mistakes.where("student_id IS NOT NULL").select("student_id", "source", F.explode(F.array_distinct("tags")).alias("tag")).where("trim(tag) <> ''")
    counted = rows.groupBy("student_id", "tag").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    scored = counted.withColumn("score", score(F.col("n"), F.col("sources"))).withColumn("severity", severity(F.col("score")))
    order = Window.partitionBy("student_id").orderBy(F.desc("score"), "tag")
    return scored.withColumn("priority", F.row_number().over(order).cast("bigint")).where(F.col("priority") <= top)


def totals(mistakes: DataFrame, by: list[str]) -> DataFrame:
    """Counts by each column alone and together: (columns, level, n) of grouping sets."""
    out = mistakes.groupingSets([[c] for c in by] + [[]], *by).agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"))
    return out


def chapter_of_tags(tags: DataFrame, chunks: DataFrame) -> DataFrame:
    """(owner, chapter, matched, total): the chapter that covers most distinct tags of each owner.

    tags has owner, tag; chunks has id, chapter, knowledge_tags.  Ties go to more chunks, then to the
    smaller name.
    """
    named = chunks.where("chapter IS NOT NULL AND chapter <> ''").select("id", "chapter", F.explode(F.array_distinct("knowledge_tags")).alias("tag"))
    per = named.groupBy("chapter", "tag").agg(F.countDistinct("id").alias("chunks"))
    hits = guarded_join(tags.select("owner", "tag").distinct(), per, ["tag"]).groupBy("owner", "chapter").agg(F.count("*").alias("matched"), F.sum("chunks").alias("total"))
    order = Window.partitionBy("owner").orderBy(F.desc("matched"), F.desc("total"), "chapter")
    return hits.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def prerequisites(order: DataFrame, concepts: DataFrame, limit: int = 3) -> DataFrame:
    """(chapter, prerequisite, rank): the first concepts of the chapter before.

    order has chapter, position; concepts has chapter, concept, rank.
    """
    before = order.select((F.col("position") + 1).alias("position"), F.col("chapter").alias("earlier"))
    pairs = order.join(before, "position").select("chapter", "earlier")
    return pairs.join(concepts.where(F.col("rank") <= limit).withColumnRenamed("chapter", "earlier"), "earlier").select("chapter", F.col("concept").alias("prerequisite"), "rank")


#: Relations by which a concept comes before another, and by which it needs another; how many are named, and how sure they are.
COMES_BEFORE = ("PREREQUISITE", "PREREQUISITE_OF", "PRECEDES", "FOUNDATION_OF")
NEEDS = ("DEPENDS_ON", "REQUIRES")
NAMED, SURE, ENOUGH = 5, 0.95, 3


def prerequisites_by_edges(edges: DataFrame) -> DataFrame:
    """(concept, prerequisite, confidence, rank): what the edges (source, type, target) name, at most NAMED a concept, by name."""
    before, needs = F.col("type").isin(*COMES_BEFORE), F.col("type").isin(*NEEDS)
    pairs = edges.where(before | needs).select(F.when(before, F.col("target")).otherwise(F.col("source")).alias("concept"), F.when(before, F.col("source")).otherwise(F.col("target")).alias("prerequisite")).distinct()
    rank = F.row_number().over(Window.partitionBy("concept").orderBy("prerequisite"))
    return pairs.select("concept", "prerequisite", F.lit(SURE).alias("confidence"), rank.cast("bigint").alias("rank")).where(F.col("rank") <= NAMED)


def prerequisites_or_before(edges: DataFrame, fallback: DataFrame) -> DataFrame:
    """(concept, prerequisite, confidence, rank): by edges, and for concepts without any the given ones of the chapter before."""
    named = prerequisites_by_edges(edges)
    return named.unionByName(fallback.select(*named.columns).join(named.select("concept").distinct(), "concept", "left_anti").select(*named.columns))


def weakness_report(mistakes: DataFrame) -> DataFrame:
    """(student_id, tag, total, sufficient, mistakes, sources, chapter, score, severity, priority): all areas of every student.

    mistakes has student_id, request_id, source, chapter, tags.  chapter is the most frequent one of the
    area's mistakes; of equally frequent ones the one with the last request counts.  Fewer than ENOUGH
    mistakes of a student are not sufficient.
    """
    totals_of = mistakes.groupBy("student_id").agg(F.count("*").alias("total"))
    rows = mistakes.select("student_id", "request_id", "source", "chapter", F.explode(F.array_distinct("tags")).alias("tag")).where("trim(tag) <> ''")
    counted = rows.groupBy("student_id", "tag").agg(F.count("*").alias("mistakes"), F.countDistinct("source").alias("sources"))
    modes = rows.groupBy("student_id", "tag", "chapter").agg(F.count("*").alias("k"), F.max("request_id").alias("latest"))
    order = Window.partitionBy("student_id", "tag").orderBy(F.desc("k"), F.desc("latest"), "chapter")
    modes = modes.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("student_id", "tag", "chapter")
    scored = counted.withColumn("score", score(F.col("mistakes"), F.col("sources"))).withColumn("severity", severity(F.col("score")))
    place = F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("score"), "tag")).cast("bigint")
    out = scored.join(modes, ["student_id", "tag"]).join(totals_of, "student_id")
    return out.select("student_id", "tag", "total", (F.col("total") >= ENOUGH).alias("sufficient"), "mistakes", "sources", "chapter", "score", "severity", place.alias("priority"))
