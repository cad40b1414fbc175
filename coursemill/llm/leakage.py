"""Problem 7: evaluation texts leaking into training text.

SimHash fingerprints are taken of windows of the corpus, at every half window, and of the
evaluation items, at every token, so that a leaked passage holds at least one corpus window
that lies in phase with an item window.  A multi-index of four 16-bit blocks, each probed
within one differing bit, guarantees that all fingerprints within RADIUS bits meet.  The
pairs that meet are verified: weighted shingles of the passage must be contained in the
item, and an alignment must find a continuous passage of at least half the item with at
most one word in ten altered and every figure and device code unchanged.

Pairs that meet beyond RADIUS bits (up to ACCEPT) are looked at too, without a guarantee.

Nothing of the corpus is shuffled or collected; indexes of blocks of ITEM_BLOCK items are
broadcast, BLOCKS_A_PASS blocks for each pass over the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from coursemill.functions import codepoints as cp
from coursemill.llm.tokens import FIGURE, LETTER, Tokens, tokenize

BITS, BLOCKS, BLOCK_BITS = 64, 4, 16
#: Guaranteed by the pigeonhole principle: with at most 7 differing bits one of 4 blocks has at most 1.
RADIUS = BLOCKS * 2 - 1
#: Pairs that meet in the index are kept up to this distance.
ACCEPT = 11
WINDOWS = (16, 8, 4, 2)
SHARE = 0.5
ALTERED = 0.1
FIGURE_WEIGHT = 3
SHINGLE = 3
#: The least part of the weight of an item's shingles that the passage must share, before the alignment.
SHINGLE_SHARE = 0.25
ITEM_BLOCK = 2_000
#: The indexes of so many blocks (some 50 MB each) are held by a worker at once.
BLOCKS_A_PASS = 16


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two bit-sliced numbers of equal length."""
    out, carry = [], None
    for x, y in zip(a, b):
        if carry is None:
            out.append(x ^ y)
            carry = x & y
        else:
            both = x ^ y
            out.append(both ^ carry)
            carry = (x & y) | (both & carry)
    return [*out, carry]


def _majority(count: list[np.ndarray], window: int) -> np.ndarray:
    """Bits set in more than half of a window of 2 ** k features; ties go by a fixed mask."""
    half = count[-2]
    rest = reduce(np.bitwise_or, count[:-2]) if len(count) > 2 else np.zeros_like(half)
    tie = half & ~rest & ~count[-1]
    return count[-1] | (half & rest) | (tie & np.uint64(0x5A96_C33C_A55A_69F0))


def simhash_all(hashes: np.ndarray, window: int) -> np.ndarray:
    """Fingerprints of the windows at every position of one token stream."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums, width = [hashes], 1
    while width < window:
        sums = _add([x[: len(x) - width] for x in sums], [x[width:] for x in sums])
        width *= 2
    return _majority(sums, window)


def simhash_strided(tokens: Tokens, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints at every half window of each row, and the first token of each."""
    step = window // 2
    per_row = -(-np.diff(tokens.offsets) // step)
    blocks = int(per_row.sum())
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first_block = np.concatenate(([0], np.cumsum(per_row)))
    padded = np.zeros(blocks * step, np.uint64)
    rows = np.repeat(np.arange(len(per_row)), np.diff(tokens.offsets))
    padded[first_block[rows] * step + np.arange(len(rows)) - tokens.offsets[rows]] = tokens.hash
    table = padded.reshape(blocks, step)
    sums: list[list[np.ndarray]] = [[np.ascontiguousarray(table[:, i])] for i in range(step)]
    while len(sums) > 1:
        sums = [_add(a, b) for a, b in zip(sums[::2], sums[1::2])]
    block_row = np.repeat(np.arange(len(per_row)), per_row)
    at = np.flatnonzero(block_row[:-1] == block_row[1:])
    marks = _majority(_add([x[at] for x in sums[0]], [x[at + 1] for x in sums[0]]), window)
    return marks, tokens.offsets[block_row[at]] + (at - first_block[block_row[at]]) * step


@dataclass
class Item:
    key: int
    kind: list[int]
    hash: np.ndarray
    text: str  # the characters of all tokens
    word: list[int]  # the token of each character
    fixed: list[bool]  # by token: a figure, or letters joined to one as in a device code
    shingles: np.ndarray  # hashes, sorted
    weight: np.ndarray  # of each shingle: FIGURE_WEIGHT where it holds a figure


@dataclass
class Index:
    """Fingerprints of item windows of one size in blocks of 16 bits, each under all keys within one bit."""

    window: int
    marks: np.ndarray
    item: np.ndarray
    position: np.ndarray
    starts: list[np.ndarray]
    entries: list[np.ndarray]
    hashes: np.ndarray  # by entry: the tokens of its window
    figures: np.ndarray  # by entry: which of them are figures
    figured: np.ndarray  # by entry: whether its item is to be recognised by a window with a figure

    @classmethod
    def build(cls, window: int, items: list[tuple[int, Item]]) -> Index:
        marks, item, position, hashes, figures, figured = [], [], [], [], [], []
        for at, one in items:
            m = simhash_all(one.hash, window)
            marks.append(m)
            item.append(np.full(len(m), at))
            position.append(np.arange(len(m)))
            if len(m):
                hashes.append(np.lib.stride_tricks.sliding_window_view(one.hash, window))
                figures.append(np.lib.stride_tricks.sliding_window_view(np.array(one.kind) == FIGURE, window))
            figured.append(np.full(len(m), _needs_figure(one.kind, window)))
        if not hashes:
            hashes, figures = [np.zeros((0, window), np.uint64)], [np.zeros((0, window), bool)]
        marks, item, position, hashes, figures, figured = (np.concatenate(x) for x in (marks, item, position, hashes, figures, figured))
        flips = np.array([0, *(1 << i for i in range(BLOCK_BITS))], np.uint32)
        starts, entries = [], []
        for block in range(BLOCKS):
            key = ((marks >> np.uint64(BLOCK_BITS * block)) & np.uint64(0xFFFF)).astype(np.uint32)
            keys = (key[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            entries.append((order // len(flips)).astype(np.int32))
            starts.append(np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1)))
        return cls(window, marks, item, position, starts, entries, hashes, figures, figured)

    def agree(self, tokens: Tokens, first: np.ndarray, entry: np.ndarray, slice_size: int = 200_000) -> np.ndarray:
        """Whether corpus windows at the tokens first and item windows agree word by word, as far as a passage may be altered.

        At most one word in four differs, no figure does, and there is a figure where the item needs one.
        """
        out = []
        span = np.arange(self.window)
        padded = np.concatenate((tokens.hash, np.zeros(self.window, np.uint64)))
        for base in range(0, len(first), slice_size):
            e = entry[base : base + slice_size]
            same = padded[first[base : base + slice_size, None] + span] == self.hashes[e]
            figures = self.figures[e]
            ok = same.sum(1) * 4 >= 3 * self.window
            ok &= ~(figures & ~same).any(1)
            ok &= figures.any(1) | ~self.figured[e]
            out.append(ok)
        return np.concatenate(out or [np.zeros(0, bool)])

    def probe(self, marks: np.ndarray, slice_size: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """(window, entry) of the pairs that meet in a block and differ in at most ACCEPT bits."""
        left, right = [], []
        for base in range(0, len(marks), slice_size):
            part = marks[base : base + slice_size]
            for block in range(BLOCKS):
                key = ((part >> np.uint64(BLOCK_BITS * block)) & np.uint64(0xFFFF)).astype(np.int64)
                low, high = self.starts[block][key], self.starts[block][key + 1]
                many = high - low
                which = np.repeat(np.arange(len(part)), many)
                at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                entry = self.entries[block][at]
                near = np.bitwise_count(part[which] ^ self.marks[entry]) <= ACCEPT
                left.append(which[near] + base)
                right.append(entry[near])
        return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def _shingles(hashes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of all runs of SHINGLE tokens, sorted, and their weights."""
    n = max(len(hashes) - SHINGLE + 1, 0)
    mixed, weight = np.zeros(n, np.uint64), np.ones(n, np.int64)
    for i in range(SHINGLE):
        mixed = cp.mix(mixed * np.uint64(cp.HASH_BASE) + hashes[i : i + n])
        weight[kind[i : i + n] == FIGURE] = FIGURE_WEIGHT
    mixed, first = np.unique(mixed, return_index=True)
    return mixed, weight[first]


def _needs_figure(kind: list[int], window: int) -> bool:
    """Whether every passage of half the tokens holds, in phase, a window with a figure."""
    figures = [-1, *(i for i, k in enumerate(kind) if k == FIGURE), len(kind)]
    return max(b - a for a, b in zip(figures[:-1], figures[1:])) + window + window // 2 <= len(kind) * SHARE * 0.9


def make_items(rows: list[tuple[int, str]]) -> list[Item]:
    """The prepared items; items without tokens are left out."""
    items = []
    for key, text in rows:
        points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
        t = tokenize(points, np.array([0, len(points)]))
        if not len(t.hash):
            continue
        joined = (t.starts[1:] - t.ends[:-1] == 0) | ((t.starts[1:] - t.ends[:-1] == 1) & (t.points[t.ends[:-1]] == ord("-")))
        figure = t.kind == FIGURE
        fixed = figure.copy()
        fixed[:-1] |= joined & figure[1:] & (t.kind[:-1] == LETTER)
        fixed[1:] |= joined & figure[:-1] & (t.kind[1:] == LETTER)
        names = [x for x in t.strings(0, len(t.hash))]
        word = [i for i, x in enumerate(names) for _ in x]
        items.append(Item(key, t.kind.tolist(), t.hash, "".join(names), word, fixed.tolist(), *_shingles(t.hash, t.kind)))
    return items


def window_of(item: Item) -> int:
    """The largest window that every passage of half the item holds in phase."""
    half = len(item.kind) * SHARE * 0.9
    return next((w for w in WINDOWS if w + w // 2 - 1 <= half), WINDOWS[-1])


def make_indexes(items: list[Item]) -> list[Index]:
    groups: dict[int, list[tuple[int, Item]]] = {}
    for at, item in enumerate(items):
        groups.setdefault(window_of(item), []).append((at, item))
    return [Index.build(w, group) for w, group in groups.items()]


def passage_share(item: Item, text: str) -> float:
    """The largest part of the item, in characters, that stands in text as one continuous passage.

    text has the characters of the tokens without blanks, so lines broken inside a word or a
    figure do not matter.  At most one word in ten of the passage is altered; figures and device
    codes must be the same.
    """
    blocks = [m for m in SequenceMatcher(None, item.text, text, autojunk=False).get_matching_blocks() if m.size > 1]
    best = 0
    for i, first in enumerate(blocks):
        altered: set[int] = set()
        added = 0
        for j in range(i, len(blocks)):
            block = blocks[j]
            if j > i:
                before = blocks[j - 1]
                a0, b0 = before.a + before.size, before.b + before.size
                touched = {item.word[x] for x in range(a0, block.a)}
                if any(item.fixed[w] for w in touched) or any(c.isdigit() for c in text[b0 : block.b]):
                    break
                if a0 == block.a:
                    added += 1
                    if item.word[a0 - 1] == item.word[a0] and item.fixed[item.word[a0]]:
                        break
                altered |= touched
                if len(altered) + added > ALTERED * len(item.kind) + 1:
                    break
            start, stop = first.a, block.a + block.size
            words = item.word[stop - 1] - item.word[start] + 1
            if stop - start > best and len(altered) + added <= -(-words // round(1 / ALTERED)):
                best = stop - start
    return best / len(item.text)


def verify(item: Item, tokens: Tokens, row: int, start: int) -> bool:
    """Whether the row carries the item around the token start (where the item would begin)."""
    size = len(item.kind)
    low = max(int(tokens.offsets[row]), start - size // 4 - 2)
    high = min(int(tokens.offsets[row + 1]), start + size + size // 4 + 2)
    here, _ = _shingles(tokens.hash[low:high], tokens.kind[low:high])
    shared = int(item.weight[np.isin(item.shingles, here)].sum())
    if shared < SHINGLE_SHARE * int(item.weight.sum()):
        return False
    return passage_share(item, "".join(tokens.strings(low, high))) >= SHARE


def leaks(tokens: Tokens, items: list[Item], indexes: list[Index]) -> list[tuple[int, int]]:
    """(row, item) of the leaked items of a batch."""
    out: set[tuple[int, int]] = set()
    for index in indexes:
        marks, first = simhash_strided(tokens, index.window)
        window, entry = index.probe(marks)
        agree = index.agree(tokens, first[window], entry)
        window, entry = window[agree], entry[agree]
        if not len(window):
            continue
        at = first[window]
        rows = np.searchsorted(tokens.offsets, at, "right") - 1
        start = at - index.position[entry]
        tried: dict[tuple[int, int], list[int]] = {}
        for row, item, begin in sorted(set(zip(rows.tolist(), index.item[entry].tolist(), start.tolist()))):
            seen = tried.setdefault((row, item), [])
            if (row, item) in out or (seen and begin - seen[-1] <= max(2, len(items[item].kind) // 10)):
                continue
            seen.append(begin)
            if verify(items[item], tokens, row, begin):
                out.add((row, item))
    return sorted(out)


def find_leaks(corpus: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", block: int = ITEM_BLOCK) -> DataFrame:
    """(key, item_key): the corpus rows that carry an item, wholly or at least half of it.

    Null and empty texts carry nothing; an item without letters or figures is in nothing.
    Items reach the driver in blocks of block rows, one after the other; the indexes of BLOCKS_A_PASS
    blocks are broadcast and met in one pass over the corpus, which is read and cut into tokens
    once for all of them.  Other columns are not read.
    """
    spark = corpus.sparkSession
    listed = items.select(F.col(item_key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    schema = f"{key} {corpus.schema[key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}"
    rows = corpus.select(F.col(key).alias(key), F.col(text).alias("text")).where("text IS NOT NULL")
    out_schema = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def one_pass(blocks: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in cp.row_slices(batch, "text"):
                    tokens = tokenize(*cp.flatten(piece.column(1)))
                    for shared in blocks:
                        known, indexes = shared.value
                        found = leaks(tokens, known, indexes)
                        names = pd.DataFrame({key: piece.column(0).take(pa.array([r for r, _ in found], pa.int64())).to_pandas(), item_key: [known[i].key for _, i in found]})
                        yield pa.RecordBatch.from_pandas(names, schema=out_schema, preserve_index=False)

        return rows.mapInArrow(run, schema)

    results, blocks = [], []
    ordered = ((r.k, r.t) for r in listed.orderBy("k", "t").toLocalIterator())
    while part := list(islice(ordered, block)):
        prepared = make_items(part)
        blocks.append(spark.sparkContext.broadcast((prepared, make_indexes(prepared))))
        if len(blocks) == BLOCKS_A_PASS:
            results.append(one_pass(blocks))
            blocks = []
    if blocks or not results:
        results.append(one_pass(blocks))
    return reduce(DataFrame.unionByName, results).distinct()
