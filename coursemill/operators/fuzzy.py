"""Fuzzy text comparison by matching blocks, pruned before any pair is compared in Python."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from coursemill.functions import text as T
from coursemill.operators.joins import guarded_join
from coursemill.session import materialize

MATCH, CONFIRM, DUPLICATE = 0.72, 0.86, 0.985


def ratio(left: str | None, right: str | None) -> float:
    """Twice the matching characters by the sum of the lengths; null counts as empty, two empty texts are equal."""
    return SequenceMatcher(None, left or "", right or "").ratio()


def similarity(left: str | None, right: str | None) -> float:
    """The ratio, at least 0.70 plus a quarter of the coverage where one text contains the other, at most 1."""
    a, b = left or "", right or ""
    score = ratio(a, b)
    if a and b and (a in b or b in a):
        score = max(score, 0.70 + 0.25 * min(len(a), len(b)) / max(len(a), len(b)))
    return min(score, 1.0)


@F.pandas_udf(DoubleType())
def similarity_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """similarity of two columns."""
    for left, right in pairs:
        yield pd.Series([similarity(a, b) for a, b in zip(left, right)])


@F.pandas_udf(DoubleType())
def ratio_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """ratio of two columns."""
    for left, right in pairs:
        yield pd.Series([ratio(a, b) for a, b in zip(left, right)])


def _grams(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(2))))).alias("gram"))


def match_names(points: DataFrame, names: DataFrame, least: float = MATCH) -> DataFrame:
    """(point, name, match, confidence, confirm): each distinct point with the equal name, else the most similar one over least.

    points has point; names has name.  Names are compared by letters, figures and ideographs only.
    Pairs come from shared two-character runs, so only names with something in common are compared;
    a point that matches nothing has match "custom".  Ties go by name.
    """
    p = points.select("point").where("point IS NOT NULL").distinct().withColumn("low", T.comparison_text("point"))
    n = names.select("name").where("name IS NOT NULL").distinct().withColumn("low", T.comparison_text("name"))
    exact = p.join(n.groupBy("low").agg(F.min("name").alias("name")), "low").select("point", "name", F.lit("exact").alias("match"), F.lit(1.0).alias("confidence"))
    rest = p.join(exact.select("point"), "point", "left_anti").where("low <> ''")
    pairs = guarded_join(_grams(rest, "low", "low").withColumnRenamed("low", "p_low"), _grams(n.where("low <> ''"), "low", "low").withColumnRenamed("low", "n_low"), ["gram"]).select("p_low", "n_low").distinct()
    bound = 2 * F.least(F.length("p_low"), F.length("n_low")) / (F.length("p_low") + F.length("n_low"))
    contained = F.contains(F.col("p_low"), F.col("n_low")) | F.contains(F.col("n_low"), F.col("p_low"))
    scored = pairs.where((bound >= least) | contained).withColumn("confidence", F.round(similarity_udf("p_low", "n_low"), 4)).where(F.col("confidence") >= least)
    best = scored.join(n.withColumnRenamed("low", "n_low"), "n_low").withColumn("r", F.row_number().over(Window.partitionBy("p_low").orderBy(F.desc("confidence"), "name"))).where("r = 1")
    near = rest.withColumnRenamed("low", "p_low").join(best, "p_low").select("point", "name", F.lit("approximate").alias("match"), "confidence")
    found = exact.unionByName(near)
    custom = p.join(found.select("point"), "point", "left_anti").select("point", F.lit(None).cast("string").alias("name"), F.lit("custom").alias("match"), F.lit(0.0).alias("confidence"))
    return found.unionByName(custom).withColumn("confirm", (F.col("match") == "approximate") & (F.col("confidence") < CONFIRM))


GRAM = 5


def near_duplicates(rows: DataFrame, key: str, text: str, least: float = DUPLICATE) -> DataFrame:
    """(key, class_id, links): the class of every row, named by its smallest key, and its number of alike other texts.

    Texts are compared by letters, figures and ideographs; two are alike if twice their matching
    characters are at least least of both lengths; a class is what alike texts link, directly or
    over others.  Exact copies are one text from the start.  Candidates come from a prefix filter: with at
    most (1 - least) * (length + length) characters of difference, each undoing GRAM runs of
    characters, two alike texts share one of their rarest runs, so no pair is lost and frequent
    runs make no pairs.  Null and empty texts are left out.
    """
    texts = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), T.comparison_text(text).alias("t")).where("t <> ''")
    classes = materialize(texts.groupBy("t").agg(F.min("k").alias("k")), "texts")
    places = F.sequence(F.lit(1), F.greatest(F.length("t") - GRAM + 1, F.lit(1)))
    grams = classes.select("k", F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring(F.col("t"), i, F.lit(GRAM)))))).alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = grams.join(common, "gram")
    w = Window.partitionBy("k")
    size, place = F.count("*").over(w), F.row_number().over(w.orderBy("n", "gram"))
    loss = F.ceil((1 - least) * 2 * (F.col("size") + GRAM) / least) * GRAM  # runs that so many differing characters can undo
    prefix = ranked.withColumn("size", size).withColumn("place", place).where((F.col("place") <= loss + 1) & (F.col("n") > 1)).select("k", "gram")
    texts_of = classes.select("k", "t")
    pairs = prefix.select("gram", F.col("k").alias("a")).join(prefix.select("gram", F.col("k").alias("b")), "gram").where("a < b").select("a", "b").distinct()
    pairs = pairs.join(texts_of.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts_of.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    near = pairs.where(2 * F.least(F.length("ta"), F.length("tb")) / (F.length("ta") + F.length("tb")) >= least)
    links = materialize(near.where(ratio_udf("ta", "tb") >= least).select("a", "b"), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.groupBy(F.col("a").alias("k")).agg(F.count("*").alias("links"))
    named = classes.join(components(both), "k", "left").join(counted, "k", "left").select("t", F.coalesce("component", "k").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return texts.join(named, "t").select(F.col("k").alias(key), "class_id", "links").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(k, component): the smallest key that each end of edges (a, b, given in both directions) is linked to.

    Every round takes the smallest label of the neighbours and of the label itself, until nothing
    changes; labels are tables, nothing but the number of changes reaches the driver.
    """
    labels = materialize(edges.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("k").alias("component"), F.col("component").alias("far"))
        new = labels.join(around, "k").join(jump, "component", "left").select("k", F.least("component", "near", "far").alias("next"), "component")
        new = materialize(new, "labels")
        changed = new.where("next <> component").limit(1).count()
        labels = new.select("k", F.col("next").alias("component"))
        if not changed:
            return labels


def merge_parts(parts: list[str]) -> str:
    """Parts of one text joined, those left out that say what a kept part says."""
    kept: list[str] = []
    for part in (p.strip() for p in parts if p and p.strip()):
        low = part.lower()
        same = False
        for i, old in enumerate(kept):
            before = old.lower()
            if low in before:
                same = True
            elif before in low and len(part) >= 80:
                kept[i], same = part, True
            elif SequenceMatcher(None, before, low, autojunk=False).ratio() >= MATCH:
                same = True
            if same:
                break
        if not same:
            kept.append(part)
    return "\n".join(kept)
