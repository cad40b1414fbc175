"""Token streams of whole batches: letters, figures and ideographs of the consistent form, hashed."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from coursemill.functions import codepoints as cp
from coursemill.llm.canonical import canonicalize

SEPARATOR, LETTER, FIGURE, IDEOGRAPH = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the class, and the lower case."""
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for point in [*range(0x3400), *range(0xA000, 0xA800), *range(0x1D400, 0x1D800)]:
        char = chr(point)
        category = unicodedata.category(char)
        if category[0] in "LM":
            kind[point] = LETTER
        elif category[0] == "N":
            kind[point] = FIGURE
        small = char.lower()
        if len(small) == 1:
            lower[point] = ord(small)
    kind[0x3040:0x3100] = IDEOGRAPH
    kind[0x3400:0xA000] = IDEOGRAPH
    kind[0xAC00:0xD7A4] = IDEOGRAPH
    kind[0xF900:0xFB00] = IDEOGRAPH
    kind[0x20000:0x32000] = IDEOGRAPH
    return kind, lower


@dataclass
class Tokens:
    """points: the lower-case characters; starts, ends: of the tokens; kind, hash: of the tokens; offsets: first token of each row."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    kind: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    def strings(self, first: int, last: int) -> list[str]:
        """The tokens from first to last."""
        return [self.points[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(self.starts[first:last], self.ends[first:last])]


def drop_tags(points: np.ndarray, offsets: np.ndarray, longest: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """The texts without tags such as <b> and </p>."""
    opening = np.flatnonzero(points == ord("<"))
    closing = np.flatnonzero(points == ord(">"))
    if not len(opening) or not len(closing):
        return points, offsets
    at = np.searchsorted(closing, opening)
    opening, at = opening[at < len(closing)], at[at < len(closing)]
    end = closing[at]
    nested = np.zeros(len(opening), bool)
    nested[:-1] = opening[1:] < end[:-1]
    after = points[np.minimum(opening + 1, len(points) - 1)]
    named = (after == ord("/")) | ((after | 32 >= ord("a")) & (after | 32 <= ord("z")))
    same_row = np.searchsorted(offsets, opening, "right") == np.searchsorted(offsets, end, "right")
    ok = ~nested & named & same_row & (end - opening <= longest)
    step = np.zeros(len(points) + 1, np.int8)
    step[opening[ok]] += 1
    step[end[ok] + 1] -= 1
    return cp.keep(points, offsets, np.cumsum(step[:-1], dtype=np.int8) == 0)


def tokenize(points: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Runs of letters, runs of digits, and single ideographs; markup, blanks, points and punctuation only separate."""
    kinds, lower = _classes()
    points, offsets = drop_tags(*canonicalize(points, offsets))
    points = lower[points]
    kind = kinds[points]
    feeds = np.flatnonzero(points == ord("\n"))
    feeds = feeds[(feeds > 0) & (feeds < len(points) - 2)]
    if len(feeds):  # a figure broken by a line end is one figure
        before = (kind[feeds - 1] == FIGURE) | ((points[feeds - 1] == ord(".")) & (kind[feeds - 2] == FIGURE))
        after = (kind[feeds + 1] == FIGURE) | ((points[feeds + 1] == ord(".")) & (kind[feeds + 2] == FIGURE))
        broken = np.ones(len(points), bool)
        broken[feeds[before & after]] = False
        kind = kind[broken]
        points, offsets = cp.keep(points, offsets, broken)
    change = np.ones(len(points) + 1, bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == IDEOGRAPH)
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != SEPARATOR
    starts, ends = starts[real], ends[real]
    return Tokens(points, starts, ends, kind[starts], cp.RunHasher(points)(starts, ends), np.searchsorted(starts, offsets))
