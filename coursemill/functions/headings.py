"""Headings, question keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHAPTER = r"^\s*(第\s*[0-9一二三四五六七八九十]+\s*章|Chapter\s+[0-9]+)[\s:：.]*(.*?)\s*$"
#: Chapters without a number.
SPECIAL = ("目录", "参考文献", "附录", "部分习题参考答案", "Contents", "References", "Appendix")


def chapter_heading(line: Column) -> Column:
    """A chapter heading in one form, number and title of 2 to 32 characters; null where the line is none."""
    marker = F.regexp_replace(F.regexp_extract(line, _CHAPTER, 1), r"(第|章|[0-9一二三四五六七八九十]) +(?=[0-9一二三四五六七八九十章])", "$1")
    title = F.regexp_extract(line, _CHAPTER, 2)
    prose = title.rlike(r"[。！？，,;；]")
    return F.when((marker != "") & F.length(title).between(2, 32) & ~prose, F.concat_ws(" ", marker, title))


def section_heading(line: Column) -> Column:
    """A dotted section heading with a title of 2 to 30 characters; null where the line is none."""
    number, title = (F.regexp_extract(line, r"^\s*([0-9]+(?:\.[0-9]+){1,3})\s+(.{2,30}?)\s*$", i) for i in (1, 2))
    return F.when((number != "") & ~title.rlike(r"[。！？；]$"), F.concat_ws(" ", number, title))


def special_chapter(lines: Column) -> Column:
    """A special chapter named alone on one of the first eight lines, else null."""
    names = F.array(*[F.lit(x) for x in SPECIAL])
    bare = F.transform(F.slice(lines, 1, 8), lambda x: F.regexp_replace(x, r"\s", ""))
    return F.try_element_at(F.filter(names, lambda n: F.array_contains(bare, F.regexp_replace(n, r"\s", ""))), F.lit(1))


def section_rank(section: Column) -> Column:
    """The dotted number of a section as an array that sorts as numbers do."""
    return F.transform(F.split(F.regexp_extract(section, r"^([0-9]+(?:\.[0-9]+)*)", 1), r"\."), lambda x: F.expr("cast(null as int)") if x is None else x.try_cast("int"))


def question_number(key: Column) -> Column:
    """The dotted number at the end of a key such as ch1-2.3."""
    return F.regexp_extract(F.coalesce(key, F.lit("")), r"([0-9]+(?:\.[0-9]+)*)$", 1)


def repaired_key(key: Column, printed: Column) -> Column:
    """The key with the printed number in place of its own where they differ."""
    own = question_number(key)
    return F.when((printed != "") & (own != printed), F.concat(F.regexp_replace(key, r"[0-9]+(\.[0-9]+)*$", ""), printed)).otherwise(key)


def part_label(label: Column) -> Column:
    """A label without brackets and punctuation: "(1)" and "1." are "1"."""
    return F.regexp_replace(F.trim(F.coalesce(label, F.lit(""))), r"[()（）\[\].．、:：\s]", "")


def caption_base(caption: Column) -> Column:
    """A figure caption without the letter of its part."""
    return F.trim(F.regexp_replace(F.coalesce(caption, F.lit("")), r"\s*[(（][a-z][)）]\s*$", ""))


def caption_part(caption: Column) -> Column:
    """The letter of the part of a figure, or an empty string."""
    return F.regexp_extract(F.coalesce(caption, F.lit("")), r"[(（]([a-z])[)）]\s*$", 1)


def captions(text: Column) -> Column:
    """Figures that a text names, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?:图|Fig\. ?)\s*[0-9]+(?:[.-][0-9]+)*)"), F.lit(1)))


def points(text: Column) -> Column:
    """The first number of points ("5分", "5 points") in the first 500 characters, else null."""
    return F.regexp_extract(F.substring(text, 1, 500), r"([0-9]+(?:\.[0-9]+)?)\s*(?:分|points?)", 1).try_cast("double")
