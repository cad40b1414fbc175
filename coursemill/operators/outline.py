"""Outlines of Markdown plans as rows: sections, their items, and labelled details."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)、])\s+(.*)$")
_RULE = re.compile(r"^\s*\|?\s*:?-{2,}")
SECTIONS = ArrayType(StructType([StructField("level", IntegerType()), StructField("title", StringType()), StructField("items", ArrayType(StringType()))]))


def plain(text: str) -> str:
    """Text without emphasis, links and code marks."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"[*_`]{1,3}(\S(?:.*?\S)?)[*_`]{1,3}", r"\1", text).strip()


def items(lines: list[str]) -> list[str]:
    """Bullets, table rows (cells joined by a bar) or sentences, each once in order."""
    out: list[str] = []
    for line in lines:
        if not line.strip() or _RULE.match(line):
            continue
        bullet = _BULLET.match(line)
        if bullet:
            found = [bullet[1]]
        elif line.strip().startswith("|"):
            found = [" | ".join(c.strip() for c in line.strip().strip("|").split("|"))]
        else:
            found = re.findall(r"[^。！？!?；;]+[。！？!?；;]?", line)
        out += [plain(x) for x in found if plain(x)]
    return list(dict.fromkeys(out))


def outline(text: str | None) -> list[dict]:
    """The sections of a Markdown text; what stands before the first heading is a section without a title."""
    sections: list[dict] = [{"level": 0, "title": "", "lines": []}]
    for line in (text or "").split("\n"):
        heading = _HEADING.match(line)
        if heading:
            sections.append({"level": len(heading[1]), "title": plain(heading[2]), "lines": []})
        else:
            sections[-1]["lines"].append(line)
    out = [{"level": s["level"], "title": s["title"], "items": items(s["lines"])} for s in sections]
    return [s for s in out if s["title"] or s["items"]]


@F.pandas_udf(SECTIONS)
def sections(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The outline of each text."""
    for batch in values:
        yield pd.Series([outline(x) for x in batch])


def shorten(text: str, limit: int) -> str:
    """Text of at most limit characters, cut before a formula rather than inside one, with an ellipsis."""
    if len(text) <= limit:
        return text
    cut = text[: max(limit - 1, 0)]
    if cut.count("$") % 2:
        cut = cut[: cut.rindex("$")]
    return cut.rstrip() + "…"
