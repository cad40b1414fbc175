"""Problem 6: filling fixed-capacity containers with items.

The plan is made on the histogram of piece lengths alone, whose size is bounded by the
capacity, not by the data: shallow length combinations that fill a window below the
capacity are enumerated, non-negative least squares solves how often each is repeated, the
repeats are rounded down, and what is left of the histogram is packed greedily, largest
first, best fit.  Items of one length are interchangeable, so every item then finds its
container from its rank among the items of its length: the rank is a position in its
partition plus an offset of the partition, so no length, however frequent, meets in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursemill.session import materialize

#: A public tokenizer's ranks; the path is a parameter of every entry point.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that tokenizer cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Combinations may leave so small a part of the capacity unused.
WINDOW = 0.002
#: Partners of each length that are tried in combinations of three.
PARTNERS = 12


@lru_cache(4)
def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    """The tokenizer of a file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens, pid): the length of every text in tokens and the task that counted it; null texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, count = TaskContext.get().partitionId(), encoder(path).encode_ordinary_batch
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "n_tokens": [len(x) for x in count(batch["text"].tolist(), num_threads=1)], "pid": pid})

    rows = df.select(F.col(key).alias(key), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens int, pid int")


@dataclass
class Plan:
    """Containers of one capacity: for each length, ranges of ranks with the containers they fill."""

    capacity: int
    separator: int
    containers: int = 0
    used: int = 0
    slots: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # length: (first rank, per container, first container)
    taken: dict[int, int] = field(default_factory=dict)

    def size(self, length: int) -> int:
        """What a piece costs: its tokens and one separator; an empty text costs one."""
        return max(length + self.separator, 1)

    @property
    def room(self) -> int:
        return self.capacity + self.separator

    def add(self, parts: dict[int, int], repeat: int) -> None:
        """repeat containers with parts[length] pieces of each length."""
        for length, times in parts.items():
            self.slots.setdefault(length, []).append((self.taken.get(length, 0), times, self.containers))
            self.taken[length] = self.taken.get(length, 0) + times * repeat
            self.used += length * times * repeat
        self.containers += repeat

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The container of each piece."""
        out = np.full(len(lengths), -1, np.int64)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for low, high in zip(edges, [*edges[1:], len(order)]):
            rows = order[low:high]
            slots = np.array(self.slots[int(lengths[rows[0]])], np.int64)
            at = np.searchsorted(slots[:, 0], ranks[rows], "right") - 1
            out[rows] = slots[at, 2] + (ranks[rows] - slots[at, 0]) // slots[at, 1]
        return out


def combinations(sizes: np.ndarray, room: int, window: float = WINDOW, partners: int = PARTNERS) -> list[tuple[int, ...]]:
    """Shallow combinations of the given sizes (sorted, distinct) that fill a window below room: up to three sizes, and repeats of one."""
    least = room - max(1, int(room * window))
    found: set[tuple[int, ...]] = set()
    largest = sizes[-1]

    def fit(rest: int) -> int | None:
        at = int(np.searchsorted(sizes, rest, "right")) - 1
        return int(sizes[at]) if at >= 0 else None

    picks = sizes[np.unique(np.linspace(0, len(sizes) - 1, min(partners, len(sizes))).astype(int))].tolist()
    for a in sizes.tolist():
        if a >= least:
            found.add((a,))
            continue
        times = room // a
        if a * times >= least:
            found.add((a,) * times)
        b = fit(room - a)
        if b is not None and a + b >= least:
            found.add(tuple(sorted((a, b))))
        for middle in (*picks, a):
            rest = room - a - middle
            if rest < sizes[0] or rest > largest + room * window:
                continue
            c = fit(rest)
            if c is not None and a + middle + c >= least:
                found.add(tuple(sorted((a, middle, c))))
    return sorted(found)


def nonnegative_least_squares(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, n: int, rounds: int = 250) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - target| for a sparse A, by accelerated projected gradients."""
    m = len(target)
    scale = np.bincount(columns, values**2, n)
    degree = np.bincount(rows, values, m)
    step = 1.0 / max((np.bincount(columns, values * degree[rows], n)).max(), 1e-9)  # no eigenvalue of A'A is larger than its largest row sum
    x = np.minimum.reduceat(target[rows] / values, np.flatnonzero(np.diff(columns, prepend=-1))) / np.maximum(scale, 1) / 4
    y, t = x, 1.0
    for _ in range(rounds):
        residual = np.bincount(rows, values * y[columns], m) - target
        new = np.maximum(y - step * np.bincount(columns, values * residual[rows], n), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def make_plan(histogram: dict[int, int], capacity: int, separator: int) -> Plan:
    """The containers for so many pieces of each length; no length is over the capacity."""
    plan = Plan(capacity, separator)
    left: dict[int, int] = {}
    lengths: dict[int, list[int]] = {}
    for length, n in histogram.items():
        if n:
            lengths.setdefault(plan.size(length), []).append(length)
    by_size = {s: sum(histogram[x] for x in xs) for s, xs in lengths.items()}
    stock = {s: [[x, histogram[x]] for x in xs] for s, xs in lengths.items()}

    def take(parts: dict[int, int], repeat: int) -> None:
        """Book repeat containers of sizes; sizes that several lengths share are used up one length after the other."""
        while repeat:
            exact: dict[int, int] = {}
            now = repeat
            for s, times in parts.items():
                length, n = stock[s][-1]
                if n >= times:
                    exact[length] = times
                    now = min(now, n // times)
                else:  # the last pieces of one length and the first of another
                    now = 1
                    need, at = times, len(stock[s]) - 1
                    while need:
                        use = min(need, stock[s][at][1])
                        if use:
                            exact[stock[s][at][0]] = use
                        need, at = need - use, at - 1
            plan.add(exact, now)
            for s in parts:
                for entry in stock[s]:
                    entry[1] -= exact.get(entry[0], 0) * now
                while len(stock[s]) > 1 and not stock[s][-1][1]:
                    stock[s].pop()
            for s, times in parts.items():
                by_size[s] -= times * now
            repeat -= now

    sizes = np.array(sorted(by_size), np.int64)
    if not len(sizes):
        return plan
    chosen = combinations(sizes, plan.room)
    if chosen:
        counted = [np.unique(c, return_counts=True) for c in chosen]
        rows = np.searchsorted(sizes, np.concatenate([c[0] for c in counted]))
        columns = np.repeat(np.arange(len(counted)), [len(c[0]) for c in counted])
        values = np.concatenate([c[1] for c in counted]).astype(float)
        target = np.array([by_size[s] for s in sizes.tolist()], float)
        x = nonnegative_least_squares(rows, columns, values, target, len(chosen))
        for at in np.argsort(-x, kind="stable"):
            repeat = int(x[at])
            if repeat < 1:
                break
            parts = dict(zip(counted[at][0].tolist(), counted[at][1].tolist()))
            repeat = min(repeat, *(by_size[s] // t for s, t in parts.items()))
            if repeat:
                take(parts, repeat)
    remaining = [s for s in sizes.tolist() if by_size[s]]
    while remaining:
        parts: dict[int, int] = {}
        rest = plan.room
        at = len(remaining)
        while at:
            at = int(np.searchsorted(remaining[:at], rest, "right"))
            if not at:
                break
            s = remaining[at - 1]
            times = min(rest // s, by_size[s])
            parts[s], rest, at = times, rest - s * times, at - 1
        take(parts, max(1, min(by_size[s] // t for s, t in parts.items())))
        remaining = [s for s in remaining if by_size[s]]
    return plan


def pieces(counts: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(target_id, key, piece_no, piece_tokens, pid, pos): every text once per target, divided only where it alone exceeds the capacity.

    pos counts the pieces of one length in one task from 0.
    """
    wide = counts.crossJoin(F.broadcast(targets.select("target_id", "capacity_tokens").where("capacity_tokens > 0")))
    number = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity_tokens")), F.lit(1)).cast("int")
    cut = wide.withColumn("piece_no", F.explode(F.sequence(F.lit(1), number)))
    cut = cut.select(
        "target_id", key, "piece_no", F.least("capacity_tokens", F.col("n_tokens") - (F.col("piece_no") - 1) * F.col("capacity_tokens")).cast("int").alias("piece_tokens")
    )
    schema = cut.schema.simpleString()[7:-1].replace(":", " ") + ", pid int, pos bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            groups = batch.groupby(["target_id", "piece_tokens"], sort=False)
            pos = groups.cumcount().to_numpy()
            first = np.zeros(len(batch), np.int64)
            for name, rows in groups.indices.items():
                first[rows] = seen.get(name, 0)
                seen[name] = seen.get(name, 0) + len(rows)
            yield batch.assign(pid=pid, pos=pos + first)

    return cut.mapInPandas(run, schema)


def pack(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(target_id, key, piece_no, piece_tokens, container_id): every text with its container, for every target.

    targets has target_id, capacity_tokens and separator_tokens (cost between two pieces of one
    container); null separators cost nothing, capacities under one are passed over.  A text over
    the capacity becomes pieces of the capacity and a rest.  Null and empty texts take part with
    0 tokens.  The number of targets is a parameter of the run, their plans are made on the driver
    from histograms of at most capacity + 1 lengths.
    """
    spark = df.sparkSession
    table = materialize(pieces(token_counts(df, key, text, path), targets, key), "pieces")
    per_task = table.groupBy("target_id", "piece_tokens", "pid").agg(F.count("*").alias("n"))
    histograms: dict[int, dict[int, int]] = {}
    for row in per_task.groupBy("target_id", "piece_tokens").agg(F.sum("n").alias("n")).collect():  # at most capacity + 1 a target
        histograms.setdefault(row.target_id, {})[row.piece_tokens] = row.n
    rules = {r.target_id: (r.capacity_tokens, r.separator_tokens or 0) for r in targets.collect()}
    plans = spark.sparkContext.broadcast({t: make_plan(h, *rules[t]) for t, h in histograms.items()})
    before = F.sum("n").over(Window.partitionBy("target_id", "piece_tokens").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_task.select("target_id", "piece_tokens", "pid", F.coalesce(before, F.lit(0)).alias("offset"))
    ranked = table.join(offsets, ["target_id", "piece_tokens", "pid"]).select("target_id", key, "piece_no", "piece_tokens", (F.col("offset") + F.col("pos")).alias("rank"))
    schema = ranked.drop("rank").schema.simpleString()[7:-1].replace(":", " ") + ", container_id bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.full(len(batch), -1, np.int64)
            for target, rows in batch.groupby("target_id").indices.items():
                at[rows] = plans.value[target].place(batch["piece_tokens"].to_numpy()[rows], batch["rank"].to_numpy()[rows])
            yield batch.drop(columns="rank").assign(container_id=at)

    return ranked.mapInPandas(run, schema)


def fill_report(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, containers, pieces, tokens, fill): how full the containers are, separators counted as used."""
    per = packed.groupBy("target_id", "container_id").agg(F.count("*").alias("n"), F.sum("piece_tokens").alias("tokens"))
    per = per.join(F.broadcast(targets), "target_id").withColumn("used", F.col("tokens") + (F.col("n") - 1) * F.coalesce("separator_tokens", F.lit(0)))
    return per.groupBy("target_id").agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / F.sum("capacity_tokens"), 4).alias("fill"),
    )
