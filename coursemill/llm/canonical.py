"""Problem 1: visually identical text with different characters.

Every text is exploded to positioned code points, joined with a mapping of decompositions
and look-alikes, its combining marks are ordered by class, recomposed, and the text is
rebuilt.  The explosion happens in column batches on the workers: a batch of texts is one
flat array of code points with row offsets, the mapping is an array indexed by code point
(its size is fixed by Unicode: 0x110000 entries), so a join is one gather and no row per
character is ever shuffled.

The form keeps what a reader can see: raised, circled and italic signs, letter case, the
number of blanks and lines, and the ideographic space (twice as wide as a blank) stay.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from coursemill.functions import codepoints as cp
from coursemill.operators.joins import salted_join
from coursemill.session import materialize

#: Letters of other scripts, and variants of Latin ones, that look like plain Latin letters.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "Ү": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o",
    "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "ӏ": "l", "Ӏ": "l", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J", "ɡ": "g", "ɑ": "a",
    "օ": "o", "Օ": "O", "ս": "u", "Տ": "S", "հ": "h", "ո": "n", "ց": "g",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "‐": "-", "‑": "-",
}
#: Simplified radicals without a decomposition in Unicode's tables.
RADICALS = {"⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻢": "马", "⻥": "鱼", "⻦": "鸟", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙"}
#: Blanks as wide as an ideograph, which a reader can tell from a blank of normal width.
WIDE_BLANKS = {0x2001, 0x2003, 0x3000}
SPACE = 0x20
#: Classes with more rows are spread when their links are listed.
HOT_MEMBERS = 1_000
#: Parts of Hangul syllables, which compose by rule: first syllable, leads, vowels, finals.
SYLLABLES, LEADS, VOWELS, FINALS = 0xAC00, range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)


def _is_ignorable(point: int, category: str) -> bool:
    return category == "Cf" or 0xFE00 <= point <= 0xFE0F or point == 0x034F


def _one(point: int) -> str:
    """The consistent form of one code point."""
    char = chr(point)
    category = unicodedata.category(char)
    if _is_ignorable(point, category):
        return ""
    if category == "Zs":
        return unicodedata.normalize("NFC", char) if point in WIDE_BLANKS else " "
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if char in RADICALS:
        return RADICALS[char]
    decomposition = unicodedata.decomposition(char)
    if not decomposition:
        return char
    if decomposition[0] == "<":
        tag = decomposition[1 : decomposition.index(">")]
        visible_compat = tag == "compat" and not (0x2F00 <= point <= 0x2FD5 or point in (0xB5, 0x2103, 0x2109) or 0x2160 <= point <= 0x217F or 0xFB00 <= point <= 0xFB06)
        if tag not in ("wide", "narrow", "noBreak", "compat") or visible_compat:
            return char
        target = "".join(chr(int(x, 16)) for x in decomposition.split()[1:])
    else:
        target = unicodedata.normalize("NFD", char)
        if target[0] == char:
            return char
    return unicodedata.normalize("NFC", "".join(_one(ord(c)) if c != char else c for c in target))


class Mapping:
    """The tables: one-to-one targets, longer targets, canonical decompositions, combining classes, compositions."""

    def __init__(self) -> None:
        size = 0x110000
        self.single = np.arange(size, dtype=np.uint32)
        self.drop = np.zeros(size, bool)
        self.long: dict[int, np.ndarray] = {}
        self.is_long = np.zeros(size, bool)
        self.mark_class = np.zeros(size, np.uint8)
        self.decomposed: dict[int, np.ndarray] = {}
        compositions: dict[int, int] = {}
        for point in range(0x80, 0x30000):
            if 0x3400 <= point <= 0x9FFF or 0xAC00 <= point <= 0xF8FF or 0x20000 <= point <= 0x2F7FF:
                continue  # ideographs and syllables stand for themselves, surrogates do not occur
            char = chr(point)
            self.mark_class[point] = unicodedata.combining(char)
            target = _one(point)
            if not target:
                self.drop[point] = True
            elif len(target) == 1:
                self.single[point] = ord(target)
            else:
                self.is_long[point] = True
                self.long[point] = np.array([ord(c) for c in target], np.uint32)
            full = unicodedata.normalize("NFD", char)
            if full != char:
                self.decomposed[point] = np.array([ord(c) for c in full], np.uint32)
                half = unicodedata.normalize("NFC", full)
                pair = unicodedata.decomposition(char)
                if half == char and pair and pair[0] != "<" and " " in pair:
                    a, b = (int(x, 16) for x in pair.split())
                    compositions[a << 21 | b] = point
        self.is_decomposed = np.zeros(size, bool)
        self.is_decomposed[list(self.decomposed)] = True
        self.pairs = np.array(sorted(compositions), np.int64)
        self.composed = np.array([compositions[k] for k in sorted(compositions)], np.uint32)
        #: What may change with the sign before it: marks, second parts of compositions, and vowels and finals of syllables.
        self.follows = self.mark_class > 0
        self.follows[self.pairs & 0x1FFFFF] = True
        self.follows[VOWELS.start : VOWELS.stop] = self.follows[FINALS.start : FINALS.stop] = True


@lru_cache(1)
def mapping() -> Mapping:
    return Mapping()


def _expand(points: np.ndarray, offsets: np.ndarray, hits: np.ndarray, table: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Replace the points at hits by their longer targets."""
    length = np.ones(len(points), np.int64)
    where = np.flatnonzero(hits)
    length[where] = [len(table[int(points[i])]) for i in where]
    ends = np.concatenate(([0], np.cumsum(length)))
    out = np.repeat(points, length)
    for i in where:
        out[ends[i] : ends[i + 1]] = table[int(points[i])]
    return out, ends[offsets]


def _syllable(before: int, point: int) -> int:
    """The syllable of two of its parts, or 0."""
    if before in LEADS and point in VOWELS:
        return SYLLABLES + ((before - LEADS.start) * len(VOWELS) + point - VOWELS.start) * (len(FINALS) + 1)
    if SYLLABLES <= before < 0xD7A4 and (before - SYLLABLES) % (len(FINALS) + 1) == 0 and point in FINALS:
        return before + point - FINALS.start + 1
    return 0


def _reorder_and_compose(points: np.ndarray, m: Mapping) -> np.ndarray:
    """Canonical order and composition of one decomposed text."""
    order = m.mark_class[points]
    marks = order > 0
    if marks.any():
        starter = np.cumsum(~marks)
        points = points[np.lexsort((np.where(marks, order, 0), starter))]
    out: list[int] = []
    base, last = -1, 0
    for point in points.tolist():
        rank = int(m.mark_class[point])
        if base >= 0 and (last < rank or (last == 0 and base == len(out) - 1)):
            key = out[base] << 21 | point
            at = int(np.searchsorted(m.pairs, key))
            if at < len(m.pairs) and m.pairs[at] == key:
                out[base] = int(m.composed[at])
                continue
            if base == len(out) - 1 and (whole := _syllable(out[base], point)):
                out[base] = whole
                continue
        if rank == 0:
            base, last = len(out), 0
        else:
            last = rank
        out.append(point)
    return np.array(out, np.uint32)


def canonicalize(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of a batch of texts."""
    m = mapping()
    hits = m.is_long[points]
    if hits.any():
        points, offsets = _expand(points, offsets, hits, m.long)
    drop = m.drop[points]
    if drop.any():
        points, offsets = cp.keep(points, offsets, ~drop)
    points = m.single[points]
    marks = m.follows[points]
    if not marks.any():
        return points, offsets
    rows = np.unique(np.searchsorted(offsets, np.flatnonzero(marks), "right") - 1)
    pieces, lengths, done = [], np.diff(offsets), 0
    for row in rows:
        first, last = int(offsets[row]), int(offsets[row + 1])
        pieces.append(points[done:first])
        one = points[first:last]
        # only what lies around a mark can change: from the starter before it to the last mark of its run
        spans, at = [], 0
        where = np.flatnonzero(m.follows[one])
        for group in np.split(where, np.flatnonzero(np.diff(where) > 1) + 1):
            start, stop = max(int(group[0]) - 1, 0), int(group[-1]) + 1
            spans.append(one[at:start])
            part = one[start:stop]
            part, _ = _expand(part, np.array([0, len(part)]), m.is_decomposed[part], m.decomposed)
            spans.append(_reorder_and_compose(m.single[part], m))
            at = stop
        spans.append(one[at:])
        text = np.concatenate(spans)
        pieces.append(text)
        lengths[row] = len(text)
        done = last
    pieces.append(points[done:])
    return np.concatenate(pieces), np.concatenate(([0], np.cumsum(lengths)))


def canonical_string(text: str) -> str:
    """The consistent form of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out, _ = canonicalize(points, np.array([0, len(points)]))
    return out.astype("<u4").tobytes().decode("utf-32-le")


def canonical_texts(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """df with a column out: the consistent form of its column text.

    Null stays null, the empty text stays empty; all other columns are passed through
    (a column already named out is replaced).  Rows are neither merged nor dropped.
    """
    kept = [c for c in df.columns if c != out]
    source = df.select(*kept)
    schema = StructType([*source.schema.fields, StructField(out, StringType())])
    at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cp.row_slices(batch, text):
                column = part.column(at)
                points, offsets = canonicalize(*cp.flatten(column))
                valid = np.ones(part.num_rows, bool) if not column.null_count else column.is_valid().to_numpy(False)
                yield pa.RecordBatch.from_arrays([*part.columns, cp.unflatten(points, offsets, valid)], names=[*part.schema.names, out])

    return source.mapInArrow(run, schema)


def canonical_digests(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(row_key, form, raw): 128-bit digests of the consistent form and of the text itself; rows with null text are left out."""

    def digest(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
        data, at = memoryview(np.ascontiguousarray(points).view(np.uint8)), (offsets * 4).tolist()
        return pa.array([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:])], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cp.row_slices(batch, "text"):
                points, offsets = cp.flatten(part.column("text"))
                raw = digest(points, offsets)
                form = digest(*canonicalize(points, offsets))
                yield pa.RecordBatch.from_arrays([part.column("row_key"), form, raw], names=["row_key", "form", "raw"])

    rows = df.select(F.col(key).alias("row_key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("row_key").isNotNull())
    return rows.mapInArrow(run, "row_key string, form binary, raw binary")


def lookalike_classes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(row_key, form, raw, members, links): one row per row that looks the same as another one of different characters.

    form is the class (a digest of the consistent form), raw the spelling in it, members the number of rows of the class,
    links how many of them are spelled differently.  A row delivered again (same key and text) counts
    once.  Spellings are counted before classes are, so a group of exact copies, however large,
    shuffles one partial row per task.  Null keys and texts give no rows; empty texts are ordinary texts.
    """
    rows = materialize(canonical_digests(df, key, text).distinct(), "digests")  # read twice below
    spelled = rows.groupBy("form", "raw").agg(F.count("*").alias("n"))
    classes = spelled.groupBy("form").agg(F.count("*").alias("spellings"), F.sum("n").alias("members")).where("spellings > 1")
    spelled = spelled.join(classes, "form").select("form", "raw", "members", (F.col("members") - F.col("n")).alias("links"))
    return salted_join(rows, spelled, ["form", "raw"]).select("row_key", "form", "raw", "members", "links")


def lookalike_pairs(df: DataFrame, key: str, text: str = "text", salts: int = 16) -> DataFrame:
    """(key_a, key_b): the links of lookalike_classes one by one, key_a < key_b.

    Members of one spelling are not paired.  The members of a class of over HOT_MEMBERS rows are spread over salts.
    """
    members = materialize(lookalike_classes(df, key, text), "lookalikes")
    spread = F.when(F.col("members") > HOT_MEMBERS, salts).otherwise(1)
    left = members.withColumn("salt", F.pmod(F.xxhash64("row_key"), spread).cast("int"))
    right = members.select("form", F.col("row_key").alias("key_b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"))
    return (
        left.join(right, ["form", "salt"])
        .where((F.col("raw") != F.col("raw_b")) & (F.col("row_key") < F.col("key_b")))
        .select(F.col("row_key").alias("key_a"), "key_b")
        .distinct()
    )
