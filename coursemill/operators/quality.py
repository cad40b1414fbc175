"""Expectations on built tables, as rows of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(rows: DataFrame, by: dict[str, Column]) -> DataFrame:
    """One row: how many rows hold for each named condition, and total."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in by.items()])


def expect(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, failed, total, ok): rows that break each rule; a rule that is null for a row is broken."""
    total = rows.agg(F.count("*").alias("total"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    listed = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed")) for n in rules])
    return total.select(F.explode(listed).alias("r"), "total").select("r.rule", "r.failed", "total", (F.col("r.failed") == 0).alias("ok"))


def placeholder_share(chunks: DataFrame, is_placeholder: Column) -> DataFrame:
    """(placeholders, total, ok): fails when at least max(3, a quarter) of the chunks are placeholders."""
    out = chunks.agg(F.count_if(is_placeholder).alias("placeholders"), F.count("*").alias("total"))
    return out.withColumn("ok", F.col("placeholders") < F.greatest(F.lit(3), F.ceil(F.col("total") / 4)))
