"""Rollups of graded items and joins of answers with questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from coursemill.functions import codepoints as cp
from coursemill.operators.joins import guarded_join

BATCH = 8


def rollup(items: DataFrame, by: str, score: Column, most: Column) -> DataFrame:
    """(by, score, max_score, n): sums rounded to two places."""
    return items.groupBy(by).agg(F.round(F.sum(score), 2).alias("score"), F.round(F.sum(most), 2).alias("max_score"), F.count("*").alias("n"))


def latest(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The last row of each group by order (given as descending columns)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")


def distribute(rows: DataFrame, total: str, by: str, order: str) -> DataFrame:
    """rows with share: the total in equal parts of two places, the rest on the last row of the group."""
    w = Window.partitionBy(by)
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(order))
    whole = F.floor(F.col(total) * 100 + 0.5)
    part = F.floor(whole / n + 0.5)
    return rows.withColumn("share", F.when(place < n, part).otherwise(whole - part * (n - 1)) / 100)


def missing(expected: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that were not given."""
    return expected.select(*keys).distinct().join(given.select(*keys).distinct(), keys, "left_anti")


def completed(expected: DataFrame, given: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Every expected key with its score; absent ones score 0 and are flagged."""
    joined = expected.join(given.withColumn("_there", F.lit(True)), keys, "left")
    return joined.withColumn("absent", F.col("_there").isNull()).withColumn(score, F.coalesce(score, F.lit(0.0))).drop("_there")


def batches(rows: DataFrame, by: str, order: list[str], size: int = BATCH) -> DataFrame:
    """rows with batch: numbers from 0 over size rows of each group in order."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("bigint"))


def review(rows: DataFrame, by: str, passed: Column, confidence: Column) -> DataFrame:
    """(by, passed, confidence, n): whether all passed, and the least confidence (1 where none is given)."""
    return rows.groupBy(by).agg(F.bool_and(passed).alias("passed"), F.coalesce(F.min(confidence), F.lit(1.0)).alias("confidence"), F.count("*").alias("n"))


def masked(rows: DataFrame, hidden: list[str], teacher: bool) -> DataFrame:
    """rows as a role sees them: students do not get the hidden columns."""
    return rows if teacher else rows.drop(*hidden)


def leaked_later(rows: DataFrame, group: str, order: str, answer: str, question: str, least: int = 50) -> DataFrame:
    """(group, order, later): answers that hold the whole question of a later row of the group, of at least least characters.

    The join is on the first characters of the question and every place of the answer, so a large
    group is not paired with itself.
    """
    windows = F.transform(F.sequence(F.lit(1), F.length(answer) - least + 1), lambda i: F.xxhash64(F.substring(F.col(answer), i, F.lit(least))))
    left = rows.where(F.length(answer) >= least).select(group, F.col(order).alias("_a"), F.col(answer).alias("_answer"), F.explode(F.array_distinct(windows)).alias("_key"))
    right = rows.where(F.length(question) >= least).select(group, F.col(order).alias("_b"), F.col(question).alias("_question"), F.xxhash64(F.substring(question, 1, least)).alias("_key"))
    hits = left.join(right, [group, "_key"]).where((F.col("_a") < F.col("_b")) & F.contains(F.col("_answer"), F.col("_question")))
    return hits.select(group, F.col("_a").alias(order), F.col("_b").alias("later")).distinct()


#: Width of the runs of characters by which fragments are looked for.
RUN = 16


def anchors(rows: DataFrame, key: str, text: str, span: int, first_only: bool) -> DataFrame:
    """(key, anchor): hashes of some runs of RUN characters: of every span characters the run with the least hash.

    With first_only only that of the first span characters.  A text that holds another one of at least span characters
    has its first anchor among its own.
    """
    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("anchor", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cp.row_slices(batch, "_text"):
                points, offsets = cp.flatten(part.column(1))
                start = np.arange(max(len(points) - RUN + 1, 0))
                hashes = cp.RunHasher(points)(start, start + RUN)
                at, found = [], []
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    if b - a >= span:
                        runs = hashes[a : b - RUN + 1]
                        least = runs[: span - RUN + 1].min(keepdims=True) if first_only else np.unique(np.lib.stride_tricks.sliding_window_view(runs, span - RUN + 1).min(1))
                        at.append(np.full(len(least), row))
                        found.append(least)
                take = np.concatenate(at) if at else np.zeros(0, np.int64)
                values = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take)), pa.array(values.view(np.int64))], names=[key, "anchor"])

    return rows.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


def prune_fragments(rows: DataFrame, key: str, text: str, fragments: DataFrame, least: int = 50) -> DataFrame:
    """The rows whose text holds a fragment, with all of these taken out, the longest first, and removed, their number.

    fragments has fragment; those with fewer than least characters besides blanks are left out, and a text
    that is nothing but the fragment keeps it.  Texts and fragments meet by common anchors, so no text is
    compared with all fragments.  Null texts hold nothing.
    """
    known = fragments.where(F.length(F.regexp_replace("fragment", "[ \\t\\n\\r\\f]+", "")) >= least).select("fragment").distinct()
    named = anchors(known.withColumn("_f", F.col("fragment")), "_f", "fragment", least, True).withColumnRenamed("_f", "fragment")
    met = guarded_join(anchors(rows, key, text, least, False), named, ["anchor"]).select(key, "fragment").distinct()
    held = rows.join(met, key).where(F.contains(F.col(text), F.col("fragment")) & (F.trim(text) != F.trim("fragment")))
    listed = held.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.length("fragment")).alias("size"), "fragment"))).alias("_found"))
    pruned = F.aggregate("_found", F.col(text), lambda t, x: F.replace(t, x["fragment"], F.lit("")))
    return rows.join(listed, key).withColumn(text, pruned).withColumn("removed", F.size("_found")).drop("_found")
