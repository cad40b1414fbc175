"""What a collection keeps beside its chunks: vectors, graphs, sessions, states, recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(vector: Column) -> Column:
    """A vector of length one; a zero one stays as it is."""
    size = F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.lit(1e-12))
    return F.transform(F.array(size), lambda n: F.transform(vector, lambda x: (x / n).cast("float")))[0]


def write_vectors(rows: DataFrame, path: str, key: str, vector: str, collection: str) -> None:
    """The vectors of a collection at length one, in place of those it had; rows without a vector are left out.

    Raises where vectors differ in their number of dimensions.
    """
    kept = rows.where(F.size(vector) > 0)
    least, most = kept.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise ValueError(f"vectors of {least} and {most} dimensions")
    _replace(kept.withColumn(vector, unit(F.col(vector))).withColumn("collection", F.lit(collection)), path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, collection: str) -> None:
    """The graph of a collection, in place of the one it had; the graphs of others stay."""
    _replace(nodes.withColumn("collection", F.lit(collection)), f"{path}/nodes")
    _replace(edges.withColumn("collection", F.lit(collection)), f"{path}/edges")


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def drop_collection(spark: SparkSession, path: str, collection: str) -> bool:
    """Delete what a collection has under a path; whether there was any."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/collection={collection}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_sessions(log: DataFrame, path: str) -> None:
    """Messages by session, in folders by the first figures of the digest of its id, so that a session is found without reading the others."""
    log.withColumn("shard", F.substring(F.sha2("session_id", 256), 1, 2)).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_session(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The messages of one session, in order."""
    shard = F.substring(F.sha2(F.lit(session_id), 256), 1, 2)
    return spark.read.option("recursiveFileLookup", "false").parquet(path).where((F.col("shard") == shard) & (F.col("session_id") == session_id)).drop("shard").orderBy("seq")


def session_index(log: DataFrame) -> DataFrame:
    """(digest, session_id, updated_at): where each session is found, and when it was used last."""
    return log.groupBy("session_id").agg(F.max("created_at").alias("updated_at")).select(F.sha2("session_id", 256).alias("digest"), "session_id", "updated_at")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON files that hold a list; files that are no such list have none, and neither has a path that does not exist."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path, wholetext=True).where(F.startswith(F.ltrim("value"), F.lit("["))).select(F.explode(F.from_json("value", f"array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>")).alias("s"))
    return raw.where("s IS NOT NULL").select("s.*")


def recognised_pages(cache: DataFrame, page: list[str], arrival: str, version: int, model: str) -> DataFrame:
    """The last row of each page in a cache of recognised texts, of those that have a text and fit version and model."""
    fits = (F.col("schema_version") == version) & (F.col("model") == model) & (F.trim("text") != "")
    rest = [c for c in cache.columns if c not in page]
    last = cache.where(fits).groupBy(*page).agg(F.max_by(F.struct(*rest), F.struct(arrival, F.xxhash64("text"))).alias("r"))
    return last.select(*page, "r.*")
