"""Problem 2: splitting oversized items at natural boundaries.

Recursive separator hierarchy: a text over the limit is split by section, a section over
the limit by paragraph, then line, sentence, word and at last character.  The resulting
spans are packed greedily into pieces of at most the limit; a piece begins with up to
overlap trailing characters of the piece before, taken from a boundary where there is one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 900
OVERLAP = 140

#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "e.g i.e etc vs cf fig eq no nos vol approx dr mr mrs ms prof ca resp bzw z.b u.a d.h sec ch pp".split()
SECTION = re.compile(r"(?m)^(?=(?:#{1,6} |第.{1,4}[章节]|\d+(?:\.\d+){1,3} \S|(?:Chapter|Section) \d))")
PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[。！？!?]+[”’」』）)\"']*|\.[”’\"')]*(?=\s|$)")
WORD = re.compile(r"\s+")
HEADING = re.compile(r"^(?:#{1,6} +)?(\d+(?:\.\d+){1,3} \S.{0,60})$", re.M)


def _abbreviated(text: str, stop: int) -> bool:
    """Whether the full stop at stop belongs to an abbreviation."""
    at = stop
    while at > 0 and stop - at < 8 and (text[at - 1].isalpha() or text[at - 1] == "."):
        at -= 1
    return text[at:stop].lower() in ABBREVIATIONS


def _cuts(text: str, start: int, end: int, level: int) -> list[int]:
    """Positions inside (start, end) where the separator of a level allows a cut."""
    pattern = (SECTION, PARAGRAPH, LINE, SENTENCE, WORD)[level]
    out = []
    for m in pattern.finditer(text, start, end):
        if level == 3 and m.group()[0] == "." and (_abbreviated(text, m.start()) or m.end() < len(text) and not text[m.end()].isspace()):
            continue
        if start < m.end() < end:
            out.append(m.end())
    return out


def spans(text: str, start: int, end: int, limit: int, most: int, level: int = 0) -> Iterator[tuple[int, int, bool]]:
    """Consecutive spans of text[start:end]: (start, end, forced); only forced ones come from inside a stretch over the limit."""
    if end - start <= limit:
        yield start, end, level > 4
        return
    if level == 5:
        for at in range(start, end, most):
            yield at, min(at + most, end), True
        return
    edges = [start, *_cuts(text, start, end, level), end]
    if level == 4:  # words: no more recursion than needed
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a <= most:
                yield a, b, True
            else:
                yield from spans(text, a, b, most, most, 5)
        return
    for a, b in zip(edges[:-1], edges[1:]):
        yield from spans(text, a, b, limit, most, level + 1)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """Pieces (start, end, forced) of a text, in order; they cover it, each has at most limit characters.

    forced tells that a stretch between neighbouring natural boundaries exceeds the limit at
    this piece.  Consecutive pieces share at most overlap characters.
    """
    if len(text) <= limit:
        return [(0, len(text), False)]
    parts = list(spans(text, 0, len(text), limit, max(1, limit - overlap)))
    fine = sorted({c for level in range(4) for c in _cuts(text, 0, len(text), level)})
    words = _cuts(text, 0, len(text), 4)
    pieces: list[tuple[int, int, bool]] = []
    begin, end, forced = parts[0]
    for a, b, hard in parts[1:]:
        if b - begin <= limit:
            end, forced = b, forced or hard
            continue
        pieces.append((begin, end, forced))
        lowest = max(end - overlap, b - limit, begin + 1)
        begin = end
        for places in (fine, words):
            at = bisect_left(places, lowest)
            if at < len(places) and places[at] < end:
                begin = places[at]
                break
        else:
            if hard and lowest < end:
                begin = lowest
        end, forced = b, hard
    pieces.append((begin, end, forced))
    return pieces


def piece_pages(start: int, end: int, length: int, first: int | None, last: int | None) -> tuple[int | None, int | None]:
    """The pages of a piece, in proportion to its place in a text from page first to page last.

    Swapped ranges are put in order; where one end is missing the other stands for both.
    """
    if first is None and last is None:
        return None, None
    first, last = first if first is not None else last, last if last is not None else first
    first, last = min(first, last), max(first, last)
    pages = last - first + 1
    return first + start * pages // length, first + min((max(end, start + 1) - 1) * pages // length, pages - 1)


def split_items(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every row of df whose text has more than limit characters.

    df has id, text, page_start, page_end, section; further columns are passed over.  Result:
    id, piece_no (from 1), text, start, end (offsets in code points), page_start, page_end,
    section (the last numbered heading line before or in the piece's first line, else the
    row's), cut (natural or forced, by the whole row).  Null, empty and short texts give no
    rows; a row delivered again gives its pieces once.
    """
    schema = T.StructType.fromDDL("id string, piece_no int, start int, end int, text string, page_start int, page_end int, section string, cut string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, first, last, section in batch.itertuples(index=False):
                first, last = (None if x is None or x != x else int(x) for x in (first, last))
                headings = [(m.start(), m.group(1)) for m in HEADING.finditer(text)]
                pieces = split_text(text, limit, overlap)
                cut = "forced" if any(p[2] for p in pieces) else "natural"
                for n, (a, b, _) in enumerate(pieces, 1):
                    at = bisect_left(headings, (a + 1, "")) - 1
                    own = headings[at][1] if at >= 0 else section
                    out.append((key, n, a, b, text[a:b], *piece_pages(a, b, len(text), first, last), own, cut))
            yield pd.DataFrame(out, columns=schema.names).astype({"page_start": "Int32", "page_end": "Int32"})

    rows = df.where(F.char_length("text") > limit).select(F.col("id").cast("string"), "text", F.col("page_start").cast("int"), F.col("page_end").cast("int"), "section")
    return rows.mapInPandas(run, schema).dropDuplicates(["id", "piece_no"])
