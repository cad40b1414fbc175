"""Problem 3: noise in text from scanned pages.

An averaged-perceptron character editor decides, for every place where an edit is possible,
between keeping and replacing, deleting or inserting characters, or joining two lines whose
word was divided.  Places come from confusions of signs and from marks at line
ends: besides a few known ones, the confusions are learned from the corpus, as edits (one sign
or a pair replaced, a sign dropped or put in) that lead from rare words or runs of ideographs
to frequent ones for several different words; the evidence are counts of words, of hyphened compounds and of runs of three
ideographs over all texts, kept in a hashed table of fixed size.  A second perceptron tells
furniture (running titles, page numbers) from content by position on the page, likeness to
the titles and equality with the printed number.  Both are trained on a bounded sample of
texts (SAMPLE_ROWS) into which known noise is put; counts, candidates and decisions cover
every row.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions import codepoints as cp
from coursemill.llm.canonical import canonicalize
from coursemill.llm.perceptron import AveragedPerceptron
from coursemill.llm.sampling import bounded_sample
from coursemill.operators.joins import guarded_join

#: The sample the classifiers are fitted on has about so many texts, at most twice as many.
SAMPLE_ROWS = 3_000
#: A confusion is learned from at least so many different words or places, in which what is right is so many times as frequent.
SUPPORT = 4
RARER = 24
#: Misread variants of each word, and edits of ideographs, to train on.
VARIANTS = 4
EXAMPLES = 60_000
#: How much rarer, in powers of two, misread variants and different words are taken to be than what they resemble.
MISREAD_RARER, WORD_RARER = (4.3, 13.0), (-1.0, 3.5)
#: A word that was seen less often is no repair of another.
LEAST_EVIDENCE = 4
#: Two rows of 2 ** TABLE_BITS counters: the size of the count table, whatever the corpus.
TABLE_BITS = 21

#: Known confusions to begin with: what a scanner writes, and what may stand on the page.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("2", "z"),
    ("u", "n"), ("n", "u"), ("b", "h"), ("h", "b"), ("e", "c"), ("c", "e"), ("l", "i"), ("i", "l"), ("t", "f"), ("f", "t"), ("o", "a"), ("a", "o"), ("v", "y"), ("q", "g"), ("l", "t"), ("r", "n"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("cl", "d"), ("d", "cl"), ("ii", "n"), ("li", "h"), ("nn", "m"), ("ni", "m"), ("tl", "d"), ("lc", "k"),
    ("庄", "压"), ("岀", "出"), ("太", "大"), ("裁", "载"), ("士", "工"), ("愦", "馈"), ("硫", "流"), ("阳", "阻"), ("躁", "噪"), ("人", "入"), ("人", "出"), ("宰", "率"), ("盆", "益"), ("伴", "件"),
    ("栽", "截"), ("裁", "截"), ("直", "真"), ("菅", "管"), ("客", "容"), ("彤", "形"), ("置", "量"), ("土", "士"), ("末", "未"), ("未", "末"), ("已", "己"), ("己", "已"), ("曰", "日"), ("目", "日"), ("千", "干"), ("干", "千"),
    ("天", "大"), ("夭", "天"), ("大", "太"), ("木", "本"), ("侍", "待"), ("于", "干"), ("贝", "见"), ("兔", "免"), ("拆", "折"), ("折", "拆"), ("汽", "气"), ("幅", "副"), ("析", "折"), ("祸", "耦"), ("偶", "耦"), ("拔", "拨"), ("晶", "品"),
    ("羌", "差"), ("敉", "数"), ("入", "人"), ("日", "目"), ("待", "侍"), ("由", "申"), ("田", "由"), ("侧", "测"), ("则", "测"), ("值", "植"), ("植", "值"), ("徽", "微"), ("徵", "微"), ("秏", "耗"), ("稳", "隐"), ("隐", "稳"), ("输", "轮"), ("轮", "输"), ("相", "栢"),
]
#: Marks that divide a word at a line end.
DIVIDERS = "-‐‑¬\xad–"
#: Signs scanners write for figures.
AS_FIGURE = str.maketrans({"l": "1", "I": "1", "i": "1", "|": "1", "O": "0", "o": "0", "Q": "0", "D": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "q": "9", "g": "9", "b": "6"})
_N = r"[0-9lIi|OoSsBZzqgQDb]{1,6}"
PAGE_NUMBER = re.compile(
    rf"^[^\w|]*(?P<before>(?:pages?|pag|pp?|seite|s|第|no|nr)(?![a-z])[^\w|]*)?(?P<n>{_N})(?![A-Za-z])[^\w|]*(?P<after>(?:页|頁)?[^\w|]*(?:(?:of|von|/|共|总|out of)?[^\w|]*(?:共)?[^\w|]*{_N}[^\w|]*(?:页|頁|pages?)?)?[^\w|]*)?$", re.I
)
NUMBER_SIGN = re.compile(r"[0-9lIOoS|]")
FIRST_SIGN = re.compile(r"[^\W\d_]")
SECTION_HEADING = re.compile(r"^\d+(?:\.\d+)+\s")
SQUEEZE = re.compile(r"[^\w]|_")
LATIN_LOW, LATIN_HIGH = 0xC0, 0x250
KEEP, REPLACE, DELETE, INSERT, JOIN = "keep", "replace", "delete", "insert", "join"
ROW_SCHEMA = "tbl string, row_key string, text string, title string, chapters array<string>, printed int"


def _word_key(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def trigram_key(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Keys of runs of three ideographs."""
    return cp.mix(a.astype(np.uint64) * np.uint64(1_000_003) ** np.uint64(2) + b.astype(np.uint64) * np.uint64(1_000_003) + c.astype(np.uint64))


@dataclass
class Counts:
    """A hashed count table: the smaller of two counters, never less than the true count."""

    table: np.ndarray  # 2 x 2 ** TABLE_BITS

    @staticmethod
    def cells(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << TABLE_BITS) - 1)
        return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.cells(keys)
        return np.minimum(self.table[0][a], self.table[1][b]).astype(np.int64)

    def word(self, word: str) -> int:
        return int(self.of(_word_key([word]))[0])


def _is_ideograph(points: np.ndarray) -> np.ndarray:
    return (points >= 0x3400) & (points < 0xA000)


@lru_cache(1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for p in [*range(0x30, 0x3A)]:
        out[p] = 2
    for p in [*range(0x41, 0x5B), *range(0x61, 0x7B), *(x for x in range(LATIN_LOW, LATIN_HIGH) if x not in (0xD7, 0xF7))]:
        out[p] = 1
    out[0x2D] = 3
    return out


@dataclass
class Parsed:
    """A batch of texts: canonical points with dividers kept, words (runs of letters and figures), and joined ideographs."""

    points: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lower: np.ndarray

    def words(self, which: np.ndarray) -> list[str]:
        return [self.lower[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(self.starts[which], self.ends[which])]


def keep_dividers(points: np.ndarray) -> np.ndarray:
    """Soft hyphens and the like before a line end made visible, so that the consistent form keeps them as hyphens."""
    out = points.copy()
    soft = np.flatnonzero(points == 0xAD)
    if len(soft):
        after = np.minimum(soft + 1, len(points) - 1)
        space = (points[after] == 0x20) & (after + 1 < len(points))
        after = np.where(space, np.minimum(after + 1, len(points) - 1), after)
        out[soft[points[after] == 0x0A]] = 0xAC
    return out


def parse(points: np.ndarray, offsets: np.ndarray) -> Parsed:
    points, offsets = canonicalize(keep_dividers(points), offsets)
    kind = _letters()[points]
    alnum = (kind == 1) | (kind == 2)
    edge = np.zeros(len(points) + 1, np.int8)
    edge[1:-1] = alnum[1:].astype(np.int8) - alnum[:-1]
    if len(points):
        edge[0], edge[-1] = alnum[0], -int(alnum[-1])
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(points))]
    both = cut[alnum[cut] & alnum[cut - 1]] if len(cut) else cut
    starts = np.sort(np.concatenate((np.flatnonzero(edge == 1), both)))
    ends = np.sort(np.concatenate((np.flatnonzero(edge == -1), both)))
    lower = np.where((points >= 0x41) & (points <= 0x5A), points + 32, points)
    lower = np.where((lower >= 0xC0) & (lower <= 0xDE) & (lower != 0xD7), lower + 32, lower)
    return Parsed(points, offsets, starts, ends, lower)


def countable(p: Parsed) -> np.ndarray:
    """Words that are counted and edited: three characters or more, at least half of them letters."""
    letters = np.concatenate(([0], np.cumsum(_letters()[p.points] == 1)))
    length = p.ends - p.starts
    return (length >= 3) & ((letters[p.ends] - letters[p.starts]) * 2 >= length)


def at_line_edge(p: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """For each word, whether a divider and a line end follow it, and whether such stand before it."""
    n = len(p.points)
    pad = np.concatenate((p.points, np.zeros(3, np.uint32)))
    divider = np.isin(pad, [0x2D, 0xAC, 0x2010, 0x2011, 0x2013])
    one, two = pad[np.minimum(p.ends + 1, n)], pad[np.minimum(p.ends + 2, n)]
    before_end = divider[p.ends] & ((one == 0x0A) | ((one == 0x20) & (two == 0x0A)))
    after_start = np.zeros(len(p.starts), bool)
    after_start[1:] = before_end[:-1] & (p.starts[1:] - p.ends[:-1] <= 4)
    return before_end, after_start


def joined_ideographs(p: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ideographs, and whether each follows the one before without anything but a line end and indentation between."""
    at = np.flatnonzero(_is_ideograph(p.points))
    follows = np.zeros(len(at), bool)
    if len(at) > 1:
        gap = at[1:] - at[:-1]
        empty = (p.points == 0x0A) | (p.points == 0x20) | (p.points == 0x3000)
        blanks = np.concatenate(([0], np.cumsum(empty)))
        between = blanks[at[1:]] - blanks[at[:-1] + 1]
        follows[1:] = (gap == 1) | ((gap <= 4) & (between == gap - 1) & (p.points[np.minimum(at[:-1] + 1, len(p.points) - 1)] == 0x0A))
        row = np.searchsorted(p.offsets, at, "right")
        follows[1:] &= row[1:] == row[:-1]
    return at, follows


def count_keys(p: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the words, hyphened compounds and ideograph runs of a batch."""
    before_end, after_start = at_line_edge(p)
    which = np.flatnonzero(countable(p) & ~before_end & ~after_start)
    hashed = cp.RunHasher(p.lower)(p.starts[which], p.ends[which])
    keys, first, many = np.unique(hashed, return_index=True, return_counts=True)
    word_keys = _word_key(p.words(which[first]))
    # compounds within a line: word, hyphen, word
    left = np.flatnonzero((p.starts[1:] - p.ends[:-1] == 1) & np.isin(p.points[p.ends[:-1]], [0x2D])) if len(p.starts) > 1 else np.zeros(0, int)
    compound = cp.RunHasher(p.lower)(p.starts[left], p.ends[left + 1]) if len(left) else np.zeros(0, np.uint64)
    _, cfirst, cmany = np.unique(compound, return_index=True, return_counts=True)
    pairs = [p.lower[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(p.starts[left[cfirst]], p.ends[left[cfirst] + 1])]
    at, follows = joined_ideographs(p)
    run = np.flatnonzero(follows[2:] & follows[1:-1]) + 2 if len(at) > 2 else np.zeros(0, int)
    tri, tmany = np.unique(trigram_key(p.points[at[run - 2]], p.points[at[run - 1]], p.points[at[run]]), return_counts=True)
    return np.concatenate((word_keys, _word_key(pairs), tri)), np.concatenate((many, cmany, tmany))


def count_corpus(rows: DataFrame) -> Counts:
    """The count table of all rows; at most 2 ** (TABLE_BITS + 1) counters reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in cp.row_slices(batch, "text"):
                k, n = count_keys(parse(*cp.flatten(part.column(0))))
                keys, counts = np.concatenate((keys, k)), np.concatenate((counts, n))
                if len(keys) > 400_000:
                    keys, at = np.unique(keys, return_inverse=True)
                    counts = np.bincount(at, counts).astype(np.int64)
                    if len(keys) > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["k", "n"])
                        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, counts, len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["k", "n"])

    summed = rows.select("text").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1")
    mask = (1 << TABLE_BITS) - 1
    cells = F.array(F.col("k").bitwiseAND(mask), F.shiftrightunsigned("k", 32).bitwiseAND(mask) + (1 << TABLE_BITS))
    cells = summed.select(F.explode(cells).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(2 << TABLE_BITS, np.uint32)
    table[cells["cell"].to_numpy(np.int64)] = np.minimum(cells["n"].to_numpy(np.int64), 0xFFFFFFFF)
    return Counts(table.reshape(2, -1))


def _bin(n: float) -> int:
    return min(int(math.log2(n + 1)), 14)


@dataclass
class Confusions:
    """What scanners write for what: pairs of Latin signs (either may be empty), and for each ideograph what may stand for it."""

    latin: list[tuple[str, str]]
    ideographs: dict[int, list[int]]

    @classmethod
    def of(cls, pairs: Iterable[tuple[str, str]]) -> Confusions:
        latin, ideographs = [], {}
        for seen, truth in dict.fromkeys(pairs):
            if ord((seen or truth)[0]) < 0x2E80:
                latin.append((seen, truth))
            else:
                ideographs.setdefault(ord(seen), []).append(ord(truth))
        return cls(latin, ideographs)

    def pairs(self) -> list[tuple[str, str]]:
        return [*self.latin, *((chr(a), chr(b)) for a, bs in self.ideographs.items() for b in bs)]


def _holes(word: str) -> Iterator[tuple[str, str]]:
    """The word with each sign, each pair and each gap between signs taken out: (word with a hole, what was there)."""
    for i in range(len(word) + 1):
        yield f"{word[:i]}\0{word[i:]}", ""
        for size in (1, 2):
            if i + size <= len(word):
                yield f"{word[:i]}\0{word[i + size :]}", word[i : i + size]


def _kept(rare: dict[tuple[str, str], set], both: dict[tuple[str, str], set], known: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """The edits that several words support, and that seldom lead from one ordinary word to another; where the sign has a known truth, more must."""
    taken = {seen for seen, _ in known}
    good = {pair: len(at) for pair, at in rare.items() if len(at) >= SUPPORT * (4 if pair[0] in taken else 1) and len(at) > 2 * len(both.get(pair, ()))}
    return sorted(pair for pair in good if pair not in known)


def learn_latin(words: Iterable[str], counts: Counts) -> list[tuple[str, str]]:
    """(seen, truth): the edits that lead from rare words to words RARER times as frequent."""
    words = sorted(w for w in words if w.isalnum() and len(w) <= 40)
    number = dict(zip(words, counts.of(_word_key(words)).tolist())) if words else {}
    index: dict[str, list[tuple[str, str]]] = {}
    for word in words:
        for hole, truth in _holes(word):
            index.setdefault(hole, []).append((word, truth))
    rare: dict[tuple[str, str], set] = {}
    both: dict[tuple[str, str], set] = {}
    for group in index.values():
        if len(group) < 2:
            continue
        group = sorted(group, key=lambda x: -number[x[0]])
        best, truth = group[0]  # the most frequent of the words with this hole
        for word, seen in group[1:]:
            if seen != truth and len(seen) + len(truth) < 4 and number[best] >= 4:
                (rare if number[word] * RARER <= number[best] else both).setdefault((seen, truth), set()).add(best)
    return _kept(rare, both, CONFUSIONS)


def learn_ideographs(runs: np.ndarray, counts: Counts) -> list[tuple[str, str]]:
    """(seen, truth): ideographs that are rare between two others where another one is RARER times as frequent.  runs: different runs of three."""
    if not len(runs):
        return []
    number = counts.of(trigram_key(runs[:, 0], runs[:, 1], runs[:, 2]))
    around = runs[:, 0].astype(np.int64) << 21 | runs[:, 2]
    order = np.lexsort((-number, around))
    runs, number, around = runs[order], number[order], around[order]
    head = np.concatenate(([True], around[1:] != around[:-1]))
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    other = np.flatnonzero(~head & (number[first] >= 4))
    rare: dict[tuple[str, str], set] = {}
    both: dict[tuple[str, str], set] = {}
    extreme = number[other] * RARER <= number[first[other]]
    for seen, truth, key, is_rare in zip(runs[other, 1].tolist(), runs[first[other], 1].tolist(), around[other].tolist(), extreme.tolist()):
        (rare if is_rare else both).setdefault((chr(seen), chr(truth)), set()).add(key)
    return _kept(rare, both, CONFUSIONS)


def alternatives(word: str, confusions: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(other word, what was seen, what it may have been) by one confusion, everywhere or at one place."""
    out = []
    for seen, truth in confusions:
        if not seen:
            out += [(word[:at] + truth + word[at:], seen, truth) for at in range(len(word) + 1)]
            continue
        at = word.find(seen)
        if at < 0:
            continue
        out.append((word.replace(seen, truth), seen, truth))
        while at >= 0:
            out.append((word[:at] + truth + word[at + len(seen) :], seen, truth))
            at = word.find(seen, at + 1)
    return out


def word_features(word: str, other: str, seen: str, truth: str, mine: int, best: int) -> tuple[list[str], str]:
    """Features of an edit of a word, and the operation it is."""
    op = REPLACE if len(seen) == len(truth) else DELETE if len(seen) > len(truth) else INSERT
    ratio = int(math.log2((best + 1) / (mine + 1)))
    digit = any(c.isdigit() for c in word)
    return [
        f"op={op}", f"ratio={max(min(ratio, 14), -3)}", f"ratio>3={ratio > 3}", f"ratio>5={ratio > 5}", f"ratio>7={ratio > 7}", f"mine={_bin(mine)}", f"best={_bin(best)}",
        f"pair={seen}>{truth}", f"digit={digit}", f"digit={digit},ratio={max(min(ratio, 10), -1)}", f"len={min(len(word), 9)}", f"mine=0:{mine == 0},best={_bin(best)}",
    ], op


def best_word(word: str, counts: Counts, confusions: list[tuple[str, str]]) -> tuple[str, str, str, int, int] | None:
    """The most frequent other word of a word, if it is more frequent at all."""
    others = alternatives(word, confusions)
    if not others:
        return None
    known = counts.of(_word_key([word, *(o[0] for o in others)])).tolist()
    at = max(range(len(others)), key=lambda i: known[i + 1])
    if known[at + 1] <= known[0] or known[at + 1] < LEAST_EVIDENCE:
        return None
    return (*others[at], known[0], known[at + 1])


def ideograph_features(mine: list[int], other: list[int], seen: str, truth: str) -> list[str]:
    """Features of replacing an ideograph, from the counts of the runs of three around it before and after."""
    m, o = max(mine, default=0), max(other, default=0)
    ratio = int(math.log2((o + 1) / (m + 1)))
    better = sum(b > 4 * a for a, b in zip(mine, other))
    worse = sum(a > b for a, b in zip(mine, other))
    return [
        "zh", f"zr={max(min(ratio, 12), -4)}", f"zr>2={ratio > 2}", f"zr>4={ratio > 4}", f"zm={_bin(m)}", f"zo={_bin(o)}", f"zbetter={better}/{len(mine)}", f"zworse={worse}",
        f"zpair={seen}>{truth}", f"zmin={_bin(min(mine, default=0))},{_bin(min(other, default=0))}", f"znone={m <= 1},{o > 3}",
    ]


def join_features(left: str, right: str, mark: str, counts: Counts) -> list[str]:
    """Features of a word divided at a line end."""
    joined, compound, a, b = counts.of(_word_key([left + right, f"{left}-{right}", left, right])).tolist()
    ratio = int(math.log2((joined + 1) / (compound + 1)))
    odd = mark not in "-‐‑–"
    return [
        "join", f"jr={max(min(ratio, 8), -8)}", f"jodd={odd}", f"jodd={odd},c={compound > 1}", f"joined={_bin(joined)}", f"compound={_bin(compound)}", f"jparts={a > 3},{b > 3}",
        f"jparts={a > 3},{b > 3},{joined > 1},{compound > 1}", f"jnone={joined == 0 and compound == 0},{odd}", f"jupper={right[:1].isupper()}",
    ]


def printed_value(text: str) -> int | None:
    digits = text.translate(AS_FIGURE)
    return int(digits) if digits.isdigit() else None


def likeness(line: str, title: str) -> tuple[float, bool]:
    """How alike a squeezed line and a title are, and whether the line is a beginning of the title."""
    if not line or not title or not 0.35 * len(title) <= len(line) <= len(title) + 4:
        return 0.0, False
    if line == title:
        return 1.0, True
    start = len(line) >= 4 and title.startswith(line)
    if sum(c in title for c in line) < 0.6 * len(line):
        return 0.0, start
    short = title[: len(line)]
    same = sum(a == b for a, b in zip(line, short)) / len(line)
    return max(same if len(line) >= 5 else 0.0, SequenceMatcher(None, line, title, autojunk=False).ratio()), start


def squeeze(text: str) -> str:
    return SQUEEZE.sub("", text.lower())


@lru_cache(200_000)
def _title_likeness(line: str, title: str) -> tuple[float, bool, bool]:
    """The better of a line as it is and without a number at either end; whether such a number is there."""
    plain = likeness(squeeze(line), squeeze(title))
    bare = re.sub(r"^\s*[\dlIO]+\s{1,}|\s{1,}[\dlIO]+\s*$", "", line)
    other = likeness(squeeze(bare), squeeze(title)) if bare != line else (0.0, False)
    return (*max(plain, other), other > plain)


@lru_cache(10_000)
def _first_sign(name: str) -> str:
    head = FIRST_SIGN.search(name)
    return head[0].lower() if head else ""


def line_features(line: str, at: int, of: int, title: str, chapters: list[str], printed: int | None) -> list[str] | None:
    """Features of a line as furniture, or None where it cannot be any. at: its place among of lines with content."""
    text = line.strip()
    edge = min(at, of - 1 - at)
    place = "edge0" if edge == 0 else "edge1" if edge == 1 else "edge2" if edge == 2 else "inner"
    number = PAGE_NUMBER.match(text) if len(text) <= 30 and NUMBER_SIGN.search(text) else None
    if number:
        value = printed_value(number["n"])
        equal = "unknown" if printed is None else "yes" if value == printed else "no"
        bare = text == number["n"]
        pure = text.isdigit()
        return [
            "number", f"eq={equal}", f"place={place}", f"eq={equal},bare={bare}", f"eq={equal},bare={bare},place={place}", f"eq={equal},digit={any(c.isdigit() for c in text)}",
            f"pure={pure},eq={equal}", f"marks={not bare},eq={equal},{place}", f"words={bool(number['before'] or number['after'])},eq={equal}",
        ]
    best: tuple[float, bool, bool] = (0.0, False, False)
    if len(text) >= 4:
        head = FIRST_SIGN.search(text)
        for name in (title, *chapters):
            if name and 0.3 * len(name) <= len(text) <= 3 * len(name) + 8:
                if place == "inner" and not (head and head[0].lower() == _first_sign(name)):
                    continue  # away from the edges a title is taken for one only from its first sign on
                best = max(best, _title_likeness(text, name))
    like, start, numbered = best
    sentence = text.endswith(("。", ".", "！", "?", ","))
    if SECTION_HEADING.match(text):
        return None
    if (like < 0.66 and not start) or (sentence and like < 0.85):
        return None
    level = round(like * 20) / 20
    return ["title", f"like={level}", f"like>.7={like > 0.7}", f"like>.85={like > 0.85}", f"start={start}", f"place={place}", f"like={level},{place}", f"start={start},{place}", f"numbered={numbered}", f"sentence={sentence}", f"sentence={sentence},like>.85={like > 0.85}"]


@dataclass
class Editor:
    """The trained perceptrons and the counts they look at."""

    counts: Counts
    confusions: Confusions
    edits: AveragedPerceptron
    furniture: AveragedPerceptron
    cache: dict[str, str | None] = field(default_factory=dict)

    def edit_word(self, word: str) -> str | None:
        """The repaired word (in lower case), or None to keep it."""
        if word not in self.cache:
            if len(self.cache) > 500_000:
                self.cache.clear()
            found, result = best_word(word, self.counts, self.confusions.latin), None
            if found:
                features, op = word_features(word, *found)
                if self.edits.predict(features, (KEEP, op)) != KEEP:
                    result = found[0]
            self.cache[word] = result
        return self.cache[word]

    def joins(self, left: str, right: str, mark: str) -> bool:
        """Whether a word divided at a line end loses its mark."""
        return self.edits.predict(join_features(left, right, mark, self.counts), (KEEP, JOIN)) == JOIN

    def line_kind(self, features: list[str]) -> str:
        return self.furniture.predict(features, ("content", "page_number") if features[0] == "number" else ("content", "header"))

    def ideographs(self, p: Parsed) -> list[tuple[int, int]]:
        """(position, right ideograph) of the misread ideographs of a batch."""
        table = self.confusions.ideographs
        at, follows = joined_ideographs(p)
        if len(at) < 2:
            return []
        suspect = np.flatnonzero(np.isin(p.points[at], list(table)))
        padded = np.concatenate(([0, 0], p.points[at], [0, 0])).astype(np.uint64)
        chain = np.concatenate(([False, False], follows, [False, False]))
        out = []
        if not len(suspect):
            return out
        seen = p.points[at[suspect]]
        windows = []
        for shift in (0, 1, 2):  # runs that begin two, one and no place before the suspect
            first = suspect + shift
            ok = chain[first + 1] & chain[first + 2]
            a, b, c = padded[first], padded[first + 1], padded[first + 2]
            windows.append((ok, a, b, c, 2 - shift))
        mine = np.stack([np.where(ok, self.counts.of(trigram_key(a, b, c)), -1) for ok, a, b, c, _ in windows])
        longest = max(len(x) for x in table.values())
        for choice in range(longest):
            other = np.array([table[int(s)][choice] if choice < len(table[int(s)]) else 0 for s in seen], np.uint64)
            theirs = []
            for ok, a, b, c, place in windows:
                parts = [a, b, c]
                parts[place] = other
                theirs.append(np.where(ok & (other > 0), self.counts.of(trigram_key(*parts)), -1))
            theirs = np.stack(theirs)
            worth = np.flatnonzero(((theirs > 2 * np.maximum(mine, 0)) & (theirs > 2)).any(0))
            for i in worth:
                valid = mine[:, i] >= 0
                features = ideograph_features(mine[valid, i].tolist(), theirs[valid, i].tolist(), chr(seen[i]), chr(int(other[i])))
                if self.edits.predict(features, (KEEP, REPLACE)) == REPLACE:
                    out.append((int(at[suspect[i]]), int(other[i])))
        return out


DIVIDED = re.compile(r"(?<=[A-Za-zÀ-ɏ0-9])([-‐‑¬–]) ?\n[ 　]*([A-Za-zÀ-ɏ]+)")
LETTER_OR_FIGURE = re.compile(r"[A-Za-zÀ-ɏ0-9]")


def divided_words(text: str) -> Iterator[tuple[str, re.Match]]:
    """The first part of each word that is followed by a mark and a line end, and the match of mark and second part."""
    for m in DIVIDED.finditer(text):
        start = m.start()
        while start and LETTER_OR_FIGURE.match(text, start - 1):
            start -= 1
        yield text[start : m.start()], m


def _noisy_word(word: str, rng: random.Random, confusions: list[tuple[str, str]]) -> tuple[str, str, str] | None:
    """A word with one confusion put in: (noisy word, seen, truth)."""
    options = [(a, b) for a, b in confusions if b in word]
    if not options:
        return None
    seen, truth = rng.choice(options)
    places = [m.start() for m in re.finditer(re.escape(truth), word)] if truth else list(range(len(word) + 1))
    at = rng.choice(places)
    noisy = word[:at] + seen + word[at + len(truth) :]
    return (noisy, seen, truth) if noisy != word else None


def train_editor(sample: pd.DataFrame, counts: Counts, seed: int = 11) -> Editor:
    """Fit both perceptrons on a sample of rows (text, title, chapters, printed) into which known noise is put."""
    rng = random.Random(seed)
    edits: list[tuple[list[str], tuple[str, ...], str]] = []
    furniture: list[tuple[list[str], tuple[str, ...], str]] = []
    vocabulary: set[str] = set()
    runs, parsed = [], []
    for text in sample["text"]:
        points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
        p = parse(points, np.array([0, len(points)]))
        parsed.append(p)
        at, follows = joined_ideographs(p)
        run = np.flatnonzero(follows[2:] & follows[1:-1]) + 2 if len(at) > 2 else np.zeros(0, int)
        runs.append(np.stack([p.points[at[run - k]] for k in (2, 1, 0)], 1).astype(np.int64) if len(run) else np.zeros((0, 3), np.int64))
        before_end, after_start = at_line_edge(p)
        vocabulary.update(p.words(np.flatnonzero(countable(p) & ~before_end & ~after_start)))
    runs = np.concatenate(runs or [np.zeros((0, 3), np.int64)])
    confusions = Confusions.of([*CONFUSIONS, *learn_latin(vocabulary, counts), *learn_ideographs(np.unique(runs, axis=0), counts)])
    reverse: dict[int, list[int]] = {}
    for a, bs in confusions.ideographs.items():
        for b in bs:
            reverse.setdefault(b, []).append(a)
    for row, p in zip(sample.itertuples(index=False), parsed):
        text = p.points.astype("<u4").tobytes().decode("utf-32-le")
        # ideographs: the text as it is, and with one put wrong
        at, follows = joined_ideographs(p)
        chars = p.points[at].tolist()
        signs = len(edits)
        for i in range(2, len(chars) - 2):
            if signs >= EXAMPLES or (chars[i] not in reverse and chars[i] not in confusions.ideographs):
                continue
            spans = [s for s in range(i - 2, i + 1) if follows[s + 1] and follows[s + 2]]
            if not spans:
                continue
            key = lambda c: [int(counts.of(trigram_key(*(np.array([c if s + k == i else chars[s + k]]) for k in range(3))))[0]) for s in spans]
            if chars[i] in reverse and rng.random() < 0.3:
                wrong = rng.choice(reverse[chars[i]])
                edits.append((ideograph_features(key(wrong), key(chars[i]), chr(wrong), chr(chars[i])), (KEEP, REPLACE), REPLACE))
            for other in confusions.ideographs.get(chars[i], []):
                mine, theirs = key(chars[i]), key(other)
                if max(mine) >= 0.02 * max(theirs):  # else the text itself may be misread here
                    edits.append((ideograph_features(mine, theirs, chr(chars[i]), chr(other)), (KEEP, REPLACE), KEEP))
        # furniture
        lines = [x for x in text.split("\n") if x.strip()]
        chapters = [c for c in (row.chapters if row.chapters is not None else []) if c]
        for i, line in enumerate(lines):
            features = line_features(line, i, len(lines), row.title or "", chapters, row.printed)
            if not features:
                continue
            edge = min(i, len(lines) - 1 - i) <= 2
            if features[0] == "number":
                number = PAGE_NUMBER.match(line.strip())
                equal = row.printed is not None and printed_value(number["n"]) == row.printed
                right = "page_number" if equal and (edge or line.strip() != number["n"]) else "content"
                furniture.append((features, ("content", "page_number"), right))
                if equal and edge:
                    wrong = int(row.printed) + rng.randint(1, 90)
                    furniture.append((line_features(line, i, len(lines), row.title or "", chapters, wrong), ("content", "page_number"), "content"))
            else:
                like = max(_title_likeness(line.strip(), t)[0] for t in (row.title or "", *chapters))
                furniture.append((features, ("content", "header"), "header" if like > 0.9 else "content" if like < 0.72 and not edge else "header" if like > 0.78 and edge else "content"))
        for name in (row.title, *chapters):  # damaged and shortened titles
            if name and len(name) >= 6:
                noisy = name[: rng.randint(max(5, int(len(name) * 0.7)), len(name))]
                options = [(a, b) for a, b in confusions.pairs() if b and b in noisy]
                if options:
                    a, b = rng.choice(options)
                    noisy = noisy.replace(b, a, 1)
                features = line_features(noisy, rng.choice([0, 1]), 20, row.title or "", chapters, row.printed)
                if features and features[0] == "title":
                    furniture.append((features, ("content", "header"), "header"))
        # marks at line ends inside words, and at the hyphen of compounds
        for m in re.finditer(r"\b([A-Za-zÀ-ɏ]{2,})-([A-Za-zÀ-ɏ]{2,})\b", text):
            edits.append((join_features(m[1].lower(), m[2].lower(), rng.choice("-‐‑"), counts), (KEEP, JOIN), KEEP))
    for word in sorted(vocabulary):
        mine = counts.word(word)
        if mine < 8 or not word.isalpha():
            continue
        for noisy in dict.fromkeys(filter(None, (_noisy_word(word, rng, confusions.latin) for _ in range(VARIANTS)))):
            seen_count = counts.word(noisy[0])
            if seen_count * 8 < mine:
                features, op = word_features(noisy[0], word, noisy[1], noisy[2], seen_count, mine)
                edits.append((features, (KEEP, op), op))
                for low, high, right in ((*MISREAD_RARER, op), (*WORD_RARER, KEEP)):  # as if it were a misreading at some rate, or a word of its own
                    features, _ = word_features(noisy[0], word, noisy[1], noisy[2], int(mine / 2 ** rng.uniform(low, high)), mine)
                    edits.append((features, (KEEP, op), right))
        found = best_word(word, counts, confusions.latin)
        if found and found[3] * 24 >= found[4]:  # a frequent word that resembles a more frequent one
            features, op = word_features(word, *found)
            edits.append((features, (KEEP, op), KEEP))
        if len(word) >= 5:
            cut = rng.randint(2, len(word) - 2)
            for mark in ("-", rng.choice("¬‐")):
                edits.append((join_features(word[:cut], word[cut:], mark, counts), (KEEP, JOIN), JOIN))
    return Editor(counts, confusions, AveragedPerceptron().train(edits), AveragedPerceptron().train(furniture))


def page_rows(pages: DataFrame, elements: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages and elements with what their furniture would say: (tbl, row_key, text, title, chapters, printed).

    printed is the number on the page where it is known, else the page with the most frequent
    distance of its source; null where neither is known.  Null and empty texts are left out;
    a row delivered again appears again.  The titles of all chapters of the source stand in for
    an empty chapter.
    """
    columns = ["text", "source", "page", "source_page", "chapter"]
    rows = pages.select(F.lit("page_documents").alias("tbl"), F.col("page_id").alias("row_key"), *columns).unionByName(
        elements.select(F.lit("layout_elements").alias("tbl"), F.col("id").alias("row_key"), *columns)
    )
    rows = rows.where("text <> '' AND row_key IS NOT NULL").withColumn("source", F.coalesce("source", F.lit("")))
    known = pages.select(F.coalesce("source", F.lit("")).alias("source"), "page", "source_page", "chapter")
    shift = known.where("source_page IS NOT NULL AND page IS NOT NULL").groupBy("source", (F.col("source_page") - F.col("page")).alias("shift")).agg(F.count("*").alias("n"))
    shift = shift.groupBy("source").agg(F.max_by("shift", F.struct("n", F.col("shift") * -1)).alias("shift"))
    named = known.where("trim(chapter) <> ''").groupBy("source", "chapter").agg(F.count("*").alias("n"))
    named = named.groupBy("source").agg(F.sort_array(F.collect_set("chapter")).alias("all_chapters"))  # the chapters of one book
    titles = sources.groupBy("source").agg(F.min("title").alias("title"))
    facts = titles.join(shift, "source", "full_outer").join(named, "source", "full_outer")
    rows = guarded_join(rows, facts, ["source"], "left")
    chapters = F.when(F.trim(F.coalesce("chapter", F.lit(""))) == "", F.coalesce("all_chapters", F.array().cast("array<string>"))).otherwise(F.array("chapter"))
    return rows.select("tbl", "row_key", "text", "title", chapters.alias("chapters"), F.coalesce("source_page", F.col("page") + F.col("shift")).cast("int").alias("printed"))


def fit(rows: DataFrame) -> Editor:
    """Counts over all rows, and perceptrons fitted on about SAMPLE_ROWS of them."""
    sample = pd.DataFrame(bounded_sample(rows, SAMPLE_ROWS), columns=rows.columns)
    sample["printed"] = [None if x is None or x != x else int(x) for x in sample["printed"]]
    return train_editor(sample, count_corpus(rows))


def _row_noise(editor: Editor, text: str, title: str, chapters: list[str], printed: int | None) -> tuple[set[str], set[int], list[re.Match]]:
    """Kinds of noise of lines and line ends of one text, the numbers of its furniture lines, and the divided words."""
    kinds: set[str] = set()
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    furniture: set[int] = set()
    for at, i in enumerate(full):
        features = line_features(lines[i], at, len(full), title, chapters, printed)
        if features:
            kind = editor.line_kind(features)
            if kind != "content":
                kinds.add(kind)
                furniture.add(i)
                if kind == "page_number" and not PAGE_NUMBER.match(lines[i].strip())["n"].isdigit():
                    kinds.add("misread")  # a letter stands for a figure
    divided = []
    if len(lines) > 1:
        for left, m in divided_words(text):
            if editor.joins(left.lower(), m[2].lower(), m[1]):
                divided.append(m)
    if divided:
        kinds.add("hyphen")
    return kinds, furniture, divided


def _misread(editor: Editor, p: Parsed) -> tuple[dict[int, str], list[tuple[int, int]]]:
    """Repaired words by their number, and repaired ideographs, of a batch."""
    before_end, after_start = at_line_edge(p)
    which = np.flatnonzero(countable(p) & ~before_end & ~after_start)
    hashed = cp.RunHasher(p.lower)(p.starts[which], p.ends[which])
    _, first, back = np.unique(hashed, return_index=True, return_inverse=True)
    repaired = [editor.edit_word(w) for w in p.words(which[first])]
    bad = np.array([r is not None for r in repaired], bool)
    words = {int(which[i]): repaired[back[i]] for i in np.flatnonzero(bad[back])} if len(which) else {}
    return words, editor.ideographs(p)


def find_noise(rows: DataFrame, editor: Editor | None = None) -> DataFrame:
    """(tbl, row_key, noise) with noise hyphen, header, page_number or misread: one row per row and kind."""
    shared = rows.sparkSession.sparkContext.broadcast(editor or fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            for part in cp.row_slices(batch, "text"):
                p = parse(*cp.flatten(part.column("text")))
                words, signs = _misread(mine, p)
                places = [int(p.starts[w]) for w in words] + [at for at, _ in signs]
                wrong = set((np.searchsorted(p.offsets, places, "right") - 1).tolist()) if places else set()
                out: list[tuple[int, str]] = [(row, "misread") for row in wrong]
                texts = cp.unflatten(p.points, p.offsets).to_pylist()
                for row, (title, chapters, printed) in enumerate(zip(part.column("title").to_pylist(), part.column("chapters").to_pylist(), part.column("printed").to_pylist())):
                    kinds, _, _ = _row_noise(mine, texts[row], title or "", [c for c in chapters or [] if c], printed)
                    out += [(row, kind) for kind in kinds]
                take = pa.array([r for r, _ in out], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("tbl").take(take), part.column("row_key").take(take), pa.array([k for _, k in out], pa.string())], names=["tbl", "row_key", "noise"])

    return rows.mapInArrow(run, "tbl string, row_key string, noise string").distinct()


def _matched_case(old: str, new: str) -> str:
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def repair(editor: Editor, p: Parsed, row: int, text: str, words: dict[int, str], signs: dict[int, int], title: str, chapters: list[str], printed: int | None) -> str:
    """One text without furniture, divided words joined, misread signs replaced, lines joined into paragraphs."""
    base = int(p.offsets[row])
    low, high = np.searchsorted(p.starts, [base, int(p.offsets[row + 1])])
    chars: list[str] = list(text)
    for at in range(base, int(p.offsets[row + 1])):
        if at in signs:
            chars[at - base] = chr(signs[at])
    for w in range(int(low), int(high)):
        if w in words:
            a, b = int(p.starts[w]) - base, int(p.ends[w]) - base
            chars[a] = _matched_case(text[a:b], words[w])
            chars[a + 1 : b] = [""] * (b - a - 1)
    _, furniture, divided = _row_noise(editor, text, title, chapters, printed)
    for m in divided:
        chars[m.start(1) : m.start(2)] = [""] * (m.start(2) - m.start(1))
    out, at = [], 0
    joined = {text.count("\n", 0, m.start(1)) for m in divided}
    for i, line in enumerate(text.split("\n")):
        part = "".join(chars[at : at + len(line)]).strip(" 　")
        indented = line[:1] in ("　", "\t") or line.startswith("  ")
        at += len(line) + 1
        if i in furniture:
            continue
        if not part:
            out.append("")
            continue
        last = out[-1] if out else ""
        heading = bool(re.match(r"^(?:\d+(?:\.\d+)+ |第.{1,4}章|Chapter \d)", part))
        if not last or heading or indented or (last.endswith(("。", ".", "!", "?", "！", "？", ":", "：")) and len(last) < 24) or re.match(r"^(?:\d+(?:\.\d+)+ |第.{1,4}章|Chapter \d)", last):
            out.append(part)
        elif (i - 1) in joined or ord(last[-1]) >= 0x2E80 or ord(part[0]) >= 0x2E80:
            out[-1] = last + part
        elif last.endswith("-"):
            out[-1] = last + part
        else:
            out[-1] = f"{last} {part}"
    return "\n".join(x for x in out if x)


def repair_texts(rows: DataFrame, editor: Editor | None = None) -> DataFrame:
    """(tbl, row_key, repaired) of every row, once."""
    shared = rows.sparkSession.sparkContext.broadcast(editor or fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            for part in cp.row_slices(batch, "text"):
                p = parse(*cp.flatten(part.column("text")))
                words, signs = _misread(mine, p)
                texts = cp.unflatten(p.points, p.offsets).to_pylist()
                facts = zip(part.column("title").to_pylist(), part.column("chapters").to_pylist(), part.column("printed").to_pylist())
                fixed = [repair(mine, p, row, texts[row], words, dict(signs), t or "", [c for c in cs or [] if c], n) for row, (t, cs, n) in enumerate(facts)]
                yield pa.RecordBatch.from_arrays([part.column("tbl"), part.column("row_key"), pa.array(fixed, pa.string())], names=["tbl", "row_key", "repaired"])

    return rows.mapInArrow(run, "tbl string, row_key string, repaired string").dropDuplicates(["tbl", "row_key"])
