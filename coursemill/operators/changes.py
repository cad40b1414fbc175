"""Tables that change: upserts, deletions with cascade, idempotent appends, bounded logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_rows(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """The first delivery of every key; ties in arrival are the same row delivered twice."""
    w = Window.partitionBy(key).orderBy(arrival)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with the last change of each key; values a change leaves null or empty stay as they were; new keys are added."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    values = [c for c in base.columns if c not in keys]
    joined = base.alias("b").join(last.alias("c"), keys, "full_outer")
    out = [*keys]
    for c in values:
        new = F.col(f"c.{c}")
        if dict(base.dtypes)[c] == "string":
            new = F.when(new != "", new)
        out.append(F.coalesce(new, F.col(f"b.{c}")).alias(c))
    return joined.select(*out)


def delete(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """base without the rows of the given keys."""
    return base.join(keys.select(*on).distinct(), on, "left_anti")


def reassign(base: DataFrame, gone: DataFrame, column: str, default: str) -> DataFrame:
    """base with default where column refers to something that is gone."""
    marked = gone.select(F.col(column)).distinct().withColumn("_gone", F.lit(True))
    return base.join(marked, column, "left").withColumn(column, F.when(F.col("_gone"), F.lit(default)).otherwise(F.col(column))).drop("_gone")


def append_once(log: DataFrame, rows: DataFrame, token: str) -> DataFrame:
    """log with the rows whose token it does not hold yet, each token once (the smallest row by all columns)."""
    rest = [c for c in rows.columns if c != token]
    new = rows.groupBy(token).agg(F.min(F.struct(*rest)).alias("r")).select(token, *[F.col(f"r.{c}").alias(c) for c in rest])
    return log.unionByName(new.join(log.select(token).distinct(), token, "left_anti").select(*log.columns))


def keep_last(log: DataFrame, by: str, order: Column, most: int) -> DataFrame:
    """The last rows of each group."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def with_default_first(rows: DataFrame, column: str, default: str) -> DataFrame:
    """rows ordered with the default first, then by name."""
    return rows.orderBy(F.col(column) != default, column)


def update(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with the values of new where it has their key; keys that base does not hold change nothing, and doing it twice changes no more.

    new has keys and some columns of base.  Of several rows of one key the largest counts; a null in it stays a null.
    """
    values = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_new"))
    joined = base.join(last, keys, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns])


def insert_unique(base: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """base with the rows of new whose name it does not have in any case; of equal new names the smallest stays, null names are left out."""
    low = F.lower(F.trim(name)).alias("_low")
    rest = [c for c in new.columns if c != name]
    once = new.where(F.col(name).isNotNull()).groupBy(low).agg(F.min(F.struct(name, *rest)).alias("_r"))
    taken = base.select(low).distinct()
    return base.unionByName(once.join(taken, "_low", "left_anti").select("_r.*"))


def rename(base: DataFrame, new: DataFrame, key: str, name: str) -> DataFrame:
    """base with the new names of keys it holds; a name that another row has in any case is refused, and the row keeps its own."""
    taken = base.select(F.col(key).alias("_k"), F.lower(name).alias("_low"))
    free = new.withColumn("_low", F.lower(name)).join(taken, "_low", "left").where(F.col("_k").isNull() | (F.col("_k") == F.col(key))).select(key, name).distinct()
    return update(base, free, [key])


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, on: list[str]) -> dict[str, DataFrame]:
    """All tables without the rows of the given keys."""
    keys = gone.select(*on).distinct()
    return {name: rows.join(keys, on, "left_anti") for name, rows in tables.items()}


def change_elements(base: DataFrame, column: str, which: Callable[[Column], Column], change: Callable[[Column], Column]) -> DataFrame:
    """base with the elements of an array changed for which which holds; a null array is an empty one."""
    empty = F.array().cast(base.schema[column].dataType)
    return base.withColumn(column, F.transform(F.coalesce(column, empty), lambda x: F.when(which(x), change(x)).otherwise(x)))


def drop_elements(base: DataFrame, column: str, which: Callable[[Column], Column]) -> DataFrame:
    """base without the elements of an array for which which holds; a null array is an empty one."""
    empty = F.array().cast(base.schema[column].dataType)
    return base.withColumn(column, F.filter(F.coalesce(column, empty), lambda x: ~F.coalesce(which(x), F.lit(False))))


def referenced(rows: DataFrame, known: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows with a flag name: whether known has their key."""
    flagged = known.select(*on).distinct().withColumn(name, F.lit(True))
    return rows.join(flagged, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))
