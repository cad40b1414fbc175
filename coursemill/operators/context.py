"""What a reader of search results sees: hits, references, context blocks, attachments, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCERPT, TAGS, FILES, FILE_CHARS, ALL_CHARS, SLICE = 360, 8, 5, 24_000, 32_000, 420


def hits(results: DataFrame, scores: list[str]) -> DataFrame:
    """results with scores rounded to four places, an excerpt of the text and the first tags."""
    rest = [c for c in results.columns if c not in (*scores, "text", "knowledge_tags")]
    rounded = [F.round(F.coalesce(F.col(s), F.lit(0.0)), 4).alias(s) for s in scores]
    tags = F.slice(F.coalesce("knowledge_tags", F.array().cast("array<string>")), 1, TAGS)
    return results.select(*rest, *rounded, F.substring("text", 1, EXCERPT).alias("excerpt"), tags.alias("tags"))


def reference(*parts: Column) -> Column:
    """The distinct non-empty parts joined by a middle dot."""
    listed = F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.array_join(F.array_distinct(F.filter(listed, lambda x: x != "")), " · ")


def context(results: DataFrame, group: str, rank: str) -> DataFrame:
    """(group, context): numbered blocks of the results of each group in order of rank."""
    head = F.format_string("[资料%d] 来源=", F.col(rank))
    block = F.concat(head, reference(F.col("source"), F.col("chapter"), F.col("section"), F.col("page")), F.lit("\n"), F.coalesce("text", F.lit("")))
    listed = results.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("l"))
    return listed.select(group, F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("context"))


def cited(results: DataFrame, group: str, rank: str, answers: DataFrame, answer: str = "answer") -> DataFrame:
    """The results whose number is cited in the answer of their group."""
    marks = answers.select(group, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(?:资料)?([0-9]{1,3})\]"), F.lit(1)))).alias("_n"))
    return results.join(marks.select(group, F.col("_n").cast("int").alias(rank)).distinct(), [group, rank], "left_semi")


def attachments(requests: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, attached): the texts of the first FILES files of each request under their names, within ALL_CHARS.

    requests has key, attachment_ids; files has id, name, text.  Unknown files are passed over, a file
    named twice counts once.
    """
    asked = requests.select(key, F.posexplode(F.slice(F.array_distinct("attachment_ids"), 1, FILES)).alias("at", "id"))
    named = asked.join(files, "id").withColumn("b", F.concat(F.lit("[附件："), "name", F.lit("]\n"), F.substring(F.coalesce("text", F.lit("")), 1, FILE_CHARS)))
    listed = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "b"))).alias("l"))
    return listed.select(key, F.substring(F.array_join(F.transform("l", lambda x: x["b"]), "\n\n"), 1, ALL_CHARS).alias("attached"))


def consume_by_name(messages: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """(group, seq, name, id): the n-th mention of a name in a group gets the n-th file of that name, each file once.

    messages has group, seq, name; files has group, id, name.
    """
    m = messages.withColumn("_n", F.row_number().over(Window.partitionBy(group, "name").orderBy("seq")))
    f = files.withColumn("_n", F.row_number().over(Window.partitionBy(group, "name").orderBy("id"))).select(group, "name", "_n", "id")
    return m.join(f, [group, "name", "_n"]).select(group, "seq", "name", "id")


def response_slices(text: Column, size: int = SLICE) -> Column:
    """A reply as an array of slices of its paragraphs, none longer than size."""
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p) != "")
    cut = F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substring(p, i * size + 1, F.lit(size))))
    return F.flatten(cut)


def seed(*parts: Column) -> Column:
    """A stable number of the joined parts."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def pick(rows: DataFrame, group: str, order: str, seed_of: Column) -> DataFrame:
    """One row of each group: the one at the seed's place, counted in order and from the start again."""
    w = Window.partitionBy(group)
    place = F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumn("_p", place).withColumn("_n", F.count("*").over(w)).where(F.col("_p") == F.pmod(seed_of, F.col("_n"))).drop("_p", "_n")


def calendar(items: DataFrame, day: str) -> DataFrame:
    """(month, day, n): the 42 days from the Monday on or before the first of each month that has items, with their number."""
    dated = items.select(F.to_date(day).alias("day")).where("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n"))
    months = dated.select(F.trunc("day", "month").alias("month")).distinct()
    start = F.date_sub(F.col("month"), F.weekday("month"))
    grid = months.withColumn("day", F.explode(F.sequence(start, F.date_add(start, 41))))
    return grid.join(dated, "day", "left").select("month", "day", F.coalesce("n", F.lit(0)).alias("n"))
