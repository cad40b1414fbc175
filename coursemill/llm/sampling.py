"""Samples for fitting whose size does not grow with the data nor with the number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, size: int) -> list[dict]:
    """About size different rows, at most 2 * size, the same ones however the rows are partitioned.

    The rows are counted; those whose 64-bit hash over all columns is divisible by count / size
    are kept, equal ones once, so all tasks together send about size rows and not size each.
    Columns must be hashable by xxhash64 (no maps).  An empty table gives no rows.
    """
    step = max(1, rows.count() // size)
    mark = F.xxhash64(*[F.col(c) for c in rows.columns])
    picked = rows.withColumn("_mark", mark).where(F.pmod("_mark", F.lit(step)) == 0)
    once = picked.groupBy("_mark").agg(*[F.first(c).alias(c) for c in rows.columns])
    kept = [r.asDict() for r in once.orderBy("_mark").limit(2 * size).collect()]
    return [{k: v for k, v in r.items() if k != "_mark"} for r in kept]
