"""Problem 5: lines repeated across one site's documents.

The operator keeps an incremental table of line counts per source.  A new partition of
pages is merged as a delta: its lines are counted alone, added to the stored counts, the
lines that thereby cross (or fall below) the threshold are found, and only the pages that
hold such a line are rebuilt.  Lines are compared by a 64-bit hash of their normalised form
(look-alikes of problem 1, letter case, blanks and runs of digits made equal).
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import codepoints as cp
from coursemill.llm.canonical import canonicalize
from coursemill.operators.joins import guarded_join
from coursemill.session import shared_dir

#: A line is repeated excessively from so many pages and from one in so many pages of its source on.
MIN_PAGES = 4
ONE_IN = 10

LINE_SCHEMA = "source string, page_id string, line_no int, line long, first boolean"
NEWLINE = 0x0A


@lru_cache(1)
def _folding() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its lower case with any digit as 0, whether it is a blank, whether it is a digit."""
    lower = np.arange(0x110000, dtype=np.uint32)
    blank, digit = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for point in [*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000)]:
        char = chr(point)
        small = char.lower()
        if len(small) == 1:
            lower[point] = ord(small)
        if char.isspace():
            blank[point] = point != NEWLINE
        if unicodedata.category(char) == "Nd":
            digit[point], lower[point] = True, ord("0")
    return lower, blank, digit


def fold_lines(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of texts without blanks and letter case, each run of digits as one 0; line feeds stay."""
    lower, blank, digit = _folding()
    points, offsets = canonicalize(points, offsets)
    points, offsets = cp.keep(points, offsets, ~blank[points])
    numeral = digit[points]
    again = np.zeros(len(points), bool)
    again[1:] = numeral[1:] & numeral[:-1]
    again[offsets[:-1][offsets[:-1] < len(points)]] = False  # a run never goes on from the row before
    return cp.keep(lower[points], offsets, ~again)


def line_hashes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number from 1, hash and length of every line of folded texts."""
    feeds = np.flatnonzero(points == NEWLINE)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((feeds, offsets[1:])), kind="stable")
    per_row = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    rows = np.repeat(np.arange(len(offsets) - 1), per_row)
    first = np.concatenate(([0], np.cumsum(per_row)))[:-1]
    number = np.arange(len(rows)) - first[rows] + 1
    return rows, number, cp.RunHasher(points)(starts, ends), ends - starts


def line_rows(pages: DataFrame) -> DataFrame:
    """(source, page_id, line_no, line, first) of every line with content, and a row with line_no 0 for each page.

    line_no counts from 1 over the text split at line feeds; first marks the first of equal
    lines of one page.  A null text is a page without lines, a null source is the source "".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cp.row_slices(batch, "text"):
                rows, number, hashes, length = line_hashes(*fold_lines(*cp.flatten(part.column("text"))))
                full = length > 0
                rows, number, hashes = rows[full], number[full], hashes[full]
                order = np.lexsort((number, hashes, rows))
                first = np.ones(len(rows), bool)
                first[order[1:]] = (rows[order[1:]] != rows[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
                every = np.arange(part.num_rows)
                take = pa.array(np.concatenate((every, rows)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("source").take(take),
                        part.column("page_id").take(take),
                        pa.array(np.concatenate((np.zeros(len(every)), number)).astype(np.int32)),
                        pa.array(np.concatenate((np.zeros(len(every), np.int64), hashes.view(np.int64)))),
                        pa.array(np.concatenate((np.zeros(len(every), bool), first))),
                    ],
                    names=["source", "page_id", "line_no", "line", "first"],
                )

    picked = pages.select(F.coalesce(F.col("source"), F.lit("")).alias("source"), F.col("page_id").cast("string").alias("page_id"), "text").where("page_id IS NOT NULL")
    return picked.mapInArrow(run, LINE_SCHEMA).distinct()


TABLES = {
    "lines": "source string, page_id string, line_no int, line long, first boolean, bucket int",
    "counts": "source string, line long, pages long, bucket int",
    "totals": "source string, pages long, bucket int",
    "repeated": "source string, line long, pages long, bucket int",
}
#: Buckets by source; a collection of thousands of sources on a large cluster takes more.
BUCKETS = 4


class SiteLines:
    """The incremental line-count tables of all sources, in the shared folder.

    merge(pages) takes the next partition.  Pages whose id was merged before under the same source
    are deliveries of the same page and change nothing.  Pages with null ids are left out.  The
    tables are in buckets by source, and a merge reads and writes only the buckets of the sources of
    its partition; the others stay as they are.  Lines of a partition are appended.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/site-lines-{uuid.uuid4().hex}"
        self.buckets = buckets
        self.version = 0
        #: By table and bucket: the versions that hold it now.
        self.heads: dict[str, dict[int, list[int]]] = {name: {} for name in TABLES}

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        heads = self.heads[name]
        paths = [f"{self.path}/{name}/v{v}/bucket={b}" for b in (heads if buckets is None else buckets) for v in heads.get(b, [])]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        parts = [
            self.spark.read.schema(TABLES[name]).option("basePath", f"{self.path}/{name}/v{v}").parquet(*[x for x in paths if f"/v{v}/" in x])
            for v in sorted({v for b in (heads if buckets is None else buckets) for v in heads.get(b, [])})
        ]
        return reduce(DataFrame.unionByName, parts)

    def _write(self, name: str, rows: DataFrame, touched: list[int] | None = None) -> list[int]:
        """Write a version of the touched buckets (all that rows have, appended to the others, where None)."""
        at = f"{self.path}/{name}/v{self.version}"
        rows.write.partitionBy("bucket").parquet(at)
        # at most as many rows as there are buckets
        filled = sorted(r.bucket for r in self.spark.read.schema(TABLES[name]).parquet(at).select("bucket").distinct().collect())
        for b in filled if touched is None else touched:
            self.heads[name][b] = [*(self.heads[name].get(b, []) if touched is None else []), *([self.version] if b in filled else [])]
        return filled

    def lines(self, buckets: list[int] | None = None) -> DataFrame:
        """All line rows merged so far."""
        return self._read("lines", buckets)

    def repeated(self) -> DataFrame:
        """(source, line, pages): the lines at or over the threshold."""
        return self._read("repeated").select("source", "line", "pages")

    def newly_crossed(self) -> DataFrame:
        """(source, line, bucket): lines whose standing changed with the last merge."""
        return self.spark.read.parquet(f"{self.path}/crossed/v{self.version}")

    def merge(self, pages: DataFrame) -> None:
        """Count a new partition, add it to the tables, and detect the lines that cross the threshold."""
        bucket = F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit(""))), F.lit(self.buckets)).cast("int")
        touched = sorted(r.bucket for r in pages.where("page_id IS NOT NULL").select(bucket.alias("bucket")).distinct().collect())  # at most as many as there are buckets
        rows = line_rows(pages).withColumn("bucket", bucket)
        self.version += 1
        if any(b in self.heads["lines"] for b in touched):
            known = self.lines(touched).where("line_no = 0").select("source", "page_id")
            rows = rows.join(known, ["source", "page_id"], "left_anti").select(*rows.columns)
        before = self._read("repeated", touched).select("source", "line", "bucket")
        self._write("lines", rows)
        rows = self.spark.read.schema(TABLES["lines"]).parquet(f"{self.path}/lines/v{self.version}")
        delta = rows.where("first").groupBy("bucket", "source", "line").agg(F.count("*").alias("pages"))
        totals = rows.where("line_no = 0").groupBy("bucket", "source").agg(F.count("*").alias("pages"))
        delta = self._read("counts", touched).unionByName(delta).groupBy("bucket", "source", "line").agg(F.sum("pages").alias("pages"))
        totals = self._read("totals", touched).unionByName(totals).groupBy("bucket", "source").agg(F.sum("pages").alias("pages"))
        self._write("counts", delta, touched)
        self._write("totals", totals, touched)
        of = self._read("totals", touched).select("source", F.col("pages").alias("of"))
        now = guarded_join(self._read("counts", touched).where(F.col("pages") >= MIN_PAGES), of, ["source"]).where(F.col("pages") * ONE_IN >= F.col("of"))
        self._write("repeated", now.select("source", "line", "pages", "bucket"), touched)
        now = self._read("repeated", touched).select("source", "line", "bucket")
        keys = ["source", "line"]  # one row each on either side
        changed = now.join(before, keys, "left_anti").unionByName(before.join(now, keys, "left_anti"))
        changed.select("source", "line", "bucket").write.parquet(f"{self.path}/crossed/v{self.version}")

    def found(self) -> DataFrame:
        """(page_id, line_no) of every repeated line."""
        rows = self.lines().where("line_no > 0").select("source", "page_id", "line_no", "line")
        return guarded_join(rows, self.repeated().select("source", "line"), ["source", "line"], "left_semi").select("page_id", "line_no")

    def _crossed_lines(self) -> DataFrame:
        """The lines merged so far in the buckets of lines whose standing changed with the last merge."""
        return self.lines(sorted(r.bucket for r in self.newly_crossed().select("bucket").distinct().collect()))  # at most as many as there are buckets

    def to_rebuild(self) -> DataFrame:
        """(page_id) of the pages that hold a line whose standing changed with the last merge."""
        rows = self._crossed_lines().where("first").select("source", "page_id", "line")
        return guarded_join(rows, self.newly_crossed().select("source", "line"), ["source", "line"], "left_semi").select("page_id").distinct()


class CleanPages:
    """Pages without the repeated lines of their source, kept up to date partition by partition.

    A merge builds the new pages, and of the older ones only those that hold a line whose standing
    changed; the others stay as they were built.
    """

    def __init__(self, index: SiteLines) -> None:
        self.index = index

    def merge(self, pages: DataFrame) -> None:
        """pages has page_id, source, text; a page delivered again changes nothing."""
        index, spark = self.index, self.index.spark
        index.merge(pages)
        version = index.version
        new = spark.read.schema(TABLES["lines"]).parquet(f"{index.path}/lines/v{version}").where("line_no = 0").select("page_id").distinct()
        texts = pages.select(F.col("page_id").cast("string").alias("page_id"), "source", "text").dropDuplicates(["page_id"]).join(new, "page_id", "left_semi")
        texts.write.parquet(f"{index.path}/texts/v{version}")
        old = index.to_rebuild().join(new, "page_id", "left_anti")
        texts = spark.read.parquet(*[f"{index.path}/texts/v{v}" for v in range(1, version + 1)])
        due = texts.join(old.unionByName(new), "page_id", "left_semi")
        drop = index.found().join(old.unionByName(new), "page_id", "left_semi")
        without_lines(due, drop).withColumn("built", F.lit(version)).write.parquet(f"{index.path}/built/v{version}")

    def pages(self) -> DataFrame:
        """(page_id, source, text, removed_lines): every page as it was built last."""
        built = self.index.spark.read.parquet(*[f"{self.index.path}/built/v{v}" for v in range(1, self.index.version + 1)])
        last = built.groupBy("page_id").agg(F.max("built").alias("built"))
        return built.join(last, ["page_id", "built"], "left_semi").drop("built")


def without_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages with the found lines taken out of text, and removed_lines, their number.

    Pages without found lines keep their text.  A null text stays null.
    """
    dropped = found.groupBy(F.col("page_id").alias("_page")).agg(F.collect_set("line_no").alias("_drop"))
    joined = pages.join(dropped, pages["page_id"].cast("string") == F.col("_page"), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col("_drop"), (i + 1).cast("int")))
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).withColumn("removed_lines", F.coalesce(F.size("_drop"), F.lit(0))).drop("_page", "_drop")


def arrival_parts(pages: DataFrame, arrival: str = "ingested_at", parts: int = 3) -> list[DataFrame]:
    """pages cut into parts by time of arrival, at equal steps between the first and the last; null arrivals go first."""
    low, high = pages.agg(F.min(F.unix_micros(arrival)), F.max(F.unix_micros(arrival))).first()
    if low is None or low == high:
        return [pages]
    step = (high - low) / parts
    at = F.coalesce(F.least(F.floor((F.unix_micros(arrival) - F.lit(low)) / F.lit(step)), F.lit(parts - 1)), F.lit(0))
    return [pages.where(at == i) for i in range(parts)]


