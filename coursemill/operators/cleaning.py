"""Page cleaning: lines, repeated edges, keep decisions, heading carry-forward, paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions import text as T
from coursemill.operators.joins import guarded_join

#: Rows of so many consecutive numbers are one task of a running value.
BLOCK = 1_000
EDGE_LINES, EDGE_LENGTH, EDGE_LEAST, EDGE_PART = 2, 80, 3, 0.08
PARAGRAPH = 260


def page_lines(pages: DataFrame, profile: str = "cjk") -> DataFrame:
    """(page_id, source, line_no, line): the normalised lines of every page, from 1; null texts have none."""
    rows = pages.where("text IS NOT NULL").select("page_id", "source", F.posexplode(normalized_lines(profile)).alias("at", "line"))
    return rows.select("page_id", "source", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def normalized_lines(profile: str = "cjk") -> Column:
    """The normalised lines of the column text as an array, so that what is asked of a line later does not normalise it again."""
    return F.transform(F.split("text", "\n", -1), lambda line: T.normalize_line(line, profile))


def composed(pages: DataFrame) -> DataFrame:
    """pages with their text under NFKC, with which the normalisation of lines begins."""
    return pages.withColumn("text", T.nfkc("text"))


def edge_noise(pages: DataFrame) -> DataFrame:
    """(source, line, n): lines that stand among the first or last two of so many pages of a source that they are furniture.

    A line counts once for each edge, so on a short page it counts twice.
    """
    both = lambda x: F.concat(F.slice(x, 1, EDGE_LINES), F.slice(F.reverse(x), 1, EDGE_LINES))
    edges = T.let(F.filter(normalized_lines(), lambda x: x != ""), both)
    lines = pages.where("text IS NOT NULL").select("source", F.explode(edges).alias("line"))
    counted = lines.where(F.length("line") <= EDGE_LENGTH).groupBy("source", "line").agg(F.count("*").alias("n"))
    pages_of = pages.groupBy("source").agg(F.countDistinct("page_id").alias("pages"))
    least = F.greatest(F.lit(EDGE_LEAST), F.floor(F.col("pages") * EDGE_PART))
    return guarded_join(counted, pages_of, ["source"]).where(F.col("n") >= least).select("source", "line", "n")


def clean_lines(pages: DataFrame) -> DataFrame:
    """The lines that are neither noise nor repeated at the edges of their source."""
    lines = page_lines(pages).where(~T.is_line_noise("line"))
    return guarded_join(lines, edge_noise(pages).select("source", "line"), ["source", "line"], "left_anti")


def keep_decisions(pages: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """pages with keep: an opening page starts an excluded range, a closing page ends it; per source by page.

    The last opening or closing page at or before a page decides; before any the page is kept.
    """
    mark = F.when(closes, F.lit(1)).when(opens, F.lit(0))
    out = carry_forward(rows=pages.withColumn("_mark", mark), group="source", order=["page", "page_id"], value="_mark", name="_last")
    return out.withColumn("keep", F.coalesce("_last", F.lit(1)) == 1).drop("_mark", "_last")


def carry_forward(rows: DataFrame, group: str, order: list[str], value: str, name: str, block: int = BLOCK) -> DataFrame:
    """rows with name: the last non-null value at or before each row of its group; order begins with a number.

    Two levels, so that a group with a third of all rows is no single task: rows are cut into blocks
    of the first order column, a window runs inside each block, and the last value of each block is
    carried over the few blocks.
    """
    cut = rows.withColumn("_block", F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-(1 << 60))))
    inside = Window.partitionBy(group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*[F.col(c) for c in order])
    blocks = cut.groupBy(group, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), before.alias("_before"))
    own = cut.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
    joined = own.join(carried, own[group].eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")), "left")
    return joined.withColumn(name, F.coalesce("_own", "_before")).drop("_block", "_g", "_b", "_own", "_before")


def as_of(rows: DataFrame, marks: DataFrame, group: str, at: str, values: list[str]) -> DataFrame:
    """rows with the values of the last mark whose at is not after theirs: a union carried forward, no range join.

    Of several marks at one place the last by its values counts.
    """
    marked = marks.groupBy(group, at).agg(F.max(F.struct(*values)).alias("_mark")).withColumn("_row", F.lit(0))
    tagged = marked.unionByName(rows.drop(*values).withColumn("_row", F.lit(1)), allowMissingColumns=True)
    out = carry_forward(tagged, group, [at, "_row"], "_mark", "_last").where("_row = 1")
    return out.select("*", *[F.col("_last")[v].alias(v) for v in values]).drop("_row", "_mark", "_last")


_HEADING = re.compile(r"^(第.{1,4}[章节]|Chapter \d+|\d+(\.\d+)+ )")


def reflow(lines: list[str]) -> list[str]:
    """Paragraphs of cleaned lines: headings stand alone, a paragraph ends with a sentence or at 260 characters."""
    out: list[str] = []
    buffer = ""
    for line in lines:
        if _HEADING.match(line) and len(line) < 70:
            if buffer:
                out.append(buffer)
            out.append(line)
            buffer = ""
            continue
        glue = " " if buffer and buffer[-1].isascii() and line[:1].isascii() else ""
        buffer += glue + line
        if buffer.endswith(("。", "！", "？", ":", "；", ".", "!", "?")) or len(buffer) >= PARAGRAPH:
            out.append(buffer)
            buffer = ""
    return [*out, buffer] if buffer else out


def clean_pages(pages: DataFrame) -> DataFrame:
    """(page_id, cleaned): the kept lines of each page, under NFKC, as paragraphs; pages without any are left out."""
    lines = clean_lines(composed(pages)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    rows = lines.select("page_id", F.transform("l", lambda x: x["line"]).alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "cleaned": ["\n\n".join(reflow(list(x))) for x in batch["lines"]]})

    return rows.mapInPandas(run, "page_id string, cleaned string")


def remove_fragments(text: Column, fragments: list[str]) -> Column:
    """text without the given literal fragments."""
    for fragment in fragments:
        text = F.replace(text, F.lit(fragment), F.lit(""))
    return text
