"""Questions from segments: parts of a text by label, assembly by key, options."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from coursemill.operators.fuzzy import merge_parts

_LABEL = re.compile(r"[(（](\d{1,2})[)）]")
PARTS = ArrayType(StructType([StructField("label", StringType()), StructField("text", StringType())]))


def split_labels(text: str | None) -> tuple[str, list[tuple[str, str]]]:
    """The stem, and the parts labelled (1), (2) and so on in sequence; labels out of sequence are references."""
    text = text or ""
    at: list[tuple[int, int, str]] = []
    for m in _LABEL.finditer(text):
        if int(m[1]) == len(at) + 1:
            at.append((m.start(), m.end(), m[1]))
    if len(at) < 2:
        return text.strip(), []
    ends = [start for start, _, _ in at[1:]] + [len(text)]
    return text[: at[0][0]].strip(), [(label, text[b:e].strip()) for (_, b, label), e in zip(at, ends)]


@F.pandas_udf(PARTS)
def labelled_parts(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The labelled parts of a text; none where it has fewer than two."""
    for batch in values:
        yield pd.Series([[{"label": a, "text": b} for a, b in split_labels(x)[1]] for x in batch])


def compose(stem: Column, parts: Column) -> Column:
    """A stem and labelled parts as one text."""
    return F.concat_ws("\n", stem, F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), p["label"], F.lit(") "), p["text"])), "\n"))


def options(values: Column) -> Column:
    """Options as (label, text), labelled A, B and so on; empty ones are dropped."""
    named = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x, i: F.struct(F.char(F.lit(65) + i).alias("label"), F.trim(x).alias("text")))
    return F.filter(named, lambda o: o["text"] != "")


def assemble(segments: DataFrame) -> DataFrame:
    """(question_key, number, prompt, options, points, page_start, page_end): segments of one key as one question.

    segments has question_key, seq, number, text, option_label, option_text, points, page.  The first
    number in order counts, near-copies of texts are said once, the longest text of each option stays.
    """
    keyed = segments.where("question_key IS NOT NULL")
    facts = keyed.groupBy("question_key").agg(
        F.min_by("number", F.when(F.coalesce("number", F.lit("")) != "", F.col("seq"))).alias("number"),
        F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("seq", "text")))).alias("texts"),
        F.max("points").alias("points"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
    )
    longest = keyed.where("option_label IS NOT NULL").groupBy("question_key", "option_label").agg(F.max_by("option_text", F.struct(F.length("option_text"), "option_text")).alias("option_text"))
    listed = longest.groupBy("question_key").agg(F.array_sort(F.collect_list(F.struct(F.col("option_label").alias("label"), F.col("option_text").alias("text")))).alias("options"))
    merged = F.pandas_udf(lambda s: s.map(lambda x: merge_parts(list(x))), StringType())
    out = facts.join(listed, "question_key", "left").withColumn("prompt", merged(F.transform("texts", lambda x: x["text"])))
    return out.select("question_key", "number", "prompt", F.coalesce("options", F.array().cast(listed.schema["options"].dataType)).alias("options"), "points", "page_start", "page_end")


def first_json(text: Column, schema: str) -> Column:
    """The first JSON object of a text (bare, or in a fence) as a struct; null where there is none."""
    return F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1), schema)
