"""Joins that hold up when one key has a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most so many rows and bytes.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20
SALTS = 16


def guarded_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """left joined with right, which is broadcast if it has at most limit rows and else shuffled with salts.

    Rows and bytes of the right side are counted first; it is read only if it has at most limit rows and
    BROADCAST_BYTES in all, so nothing larger passes the driver.  With salts, each right row is repeated
    once per salt and the left rows of one key are spread over the salts, so no key is met by a
    single task.  how is inner, left, left_semi or left_anti.  Null keys match nothing.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in right.columns), F.lit(0))
    number, size = right.agg(F.count("*"), F.sum(width)).first()
    if number <= limit and (size or 0) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.sparkSession.createDataFrame(right.toArrow(), right.schema)), on, how)
    return salted_join(left, right, on, how, salts)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """left joined with right on on; the rows of one key on the left are spread over salts tasks."""
    rest = [c for c in left.columns if c not in on] or on
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rest]), F.lit(salts)).cast("int")
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = left.withColumn("_salt", salt).join(spread, [*on, "_salt"], how)
    return joined.drop("_salt")


def null_safe_key(columns: list[str]) -> DataFrame:
    """One non-null string key of several nullable columns."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return reduce(lambda a, b: F.concat(a, F.lit("\x1f"), b), parts)
