"""A linear classifier of lines over hashed runs of characters, which scores whole batches with array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from coursemill.functions import codepoints as cp

BUCKET_BITS = 18
GRAMS = (2, 3, 4)
PERIODS = 12
LEVELS = 4


def gram_buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each length of GRAMS, the bucket of the run that begins at each point; the last length - 1 points have none."""
    key = points.astype(np.uint64)
    for n in range(2, max(GRAMS) + 1):
        key = key[:-1] * np.uint64(0x100000001B3) + points[n - 1 :] if len(key) else key
        if n in GRAMS:
            yield ((key * np.uint64(cp.HASH_BASE)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def repetition(tokens: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each run of tokens from first to last, the largest share of tokens that equal the one a fixed distance before."""
    size = np.maximum(last - first, 1)
    best = np.zeros(len(first))
    for k in range(1, PERIODS + 1):
        if len(tokens) <= k:
            break
        same = np.concatenate(([0], np.cumsum(np.concatenate((np.zeros(k, bool), tokens[k:] == tokens[:-k])))))
        from_ = np.minimum(first + k, last)
        best = np.maximum(best, (same[last] - same[from_]) / size)
    return best


class LineClassifier:
    """Multinomial logistic regression; features of a line are its runs of 2 to 4 characters and how far it repeats itself."""

    def __init__(self, classes: tuple[str, ...]) -> None:
        self.classes = classes
        self.weights = np.zeros(((1 << BUCKET_BITS) + LEVELS, len(classes)), np.float32)
        self.bias = np.zeros(len(classes))

    def scores(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """One row of scores for each line points[starts:ends]."""
        out = np.zeros((len(starts), len(self.classes)))
        total = np.zeros(len(starts))
        for n, buckets in zip(GRAMS, gram_buckets(points)):
            sums = np.zeros((len(buckets) + 1, len(self.classes)))
            np.cumsum(self.weights[buckets], axis=0, dtype=np.float64, out=sums[1:])
            low = np.minimum(starts, len(buckets))
            high = np.clip(ends - n + 1, low, len(buckets))
            out += sums[high] - sums[low]
            total += high - low
        out /= np.sqrt(np.maximum(total, 1))[:, None]
        return out + self.weights[(1 << BUCKET_BITS) + level(repeated)] + self.bias

    def posteriors(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        x = self.scores(points, starts, ends, repeated)
        x = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
        return x / x.sum(1, keepdims=True)

    def contrast(self, one: str, other: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """How much the score of one class is over that of another, for each line; for this much less is to be looked up than for all classes."""
        a, b = self.classes.index(one), self.classes.index(other)
        weight = self.weights[:, a] - self.weights[:, b]
        out, total = np.zeros(len(starts)), np.zeros(len(starts))
        for n, buckets in zip(GRAMS, gram_buckets(points)):
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(weight[buckets], dtype=np.float64, out=sums[1:])
            low = np.minimum(starts, len(buckets))
            high = np.clip(ends - n + 1, low, len(buckets))
            out += sums[high] - sums[low]
            total += high - low
        return out / np.sqrt(np.maximum(total, 1)) + weight[(1 << BUCKET_BITS) + level(repeated)] + self.bias[a] - self.bias[b]

    def train(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeated: np.ndarray, labels: np.ndarray, rounds: int = 100, step: float = 2.0, decay: float = 1e-4) -> LineClassifier:
        """Full gradients with momentum; every class has the same weight in all."""
        rows, columns, values = [], [], []
        for n, buckets in zip(GRAMS, gram_buckets(points)):
            low, high = np.minimum(starts, len(buckets)), np.clip(ends - n + 1, np.minimum(starts, len(buckets)), len(buckets))
            many = high - low
            row = np.repeat(np.arange(len(starts)), many)
            columns.append(buckets[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)])
            rows.append(row)
        row, column = np.concatenate(rows), np.concatenate(columns)
        total = np.bincount(row, minlength=len(starts))
        value = 1 / np.sqrt(np.maximum(total, 1))[row]
        used, column = np.unique(np.concatenate((column, (1 << BUCKET_BITS) + level(repeated))), return_inverse=True)
        row = np.concatenate((row, np.arange(len(starts))))
        value = np.concatenate((value, np.ones(len(starts)))).astype(np.float32)
        by_row, by_column = np.argsort(row, kind="stable"), np.argsort(column, kind="stable")
        row_starts, column_starts = np.searchsorted(row[by_row], np.arange(len(starts))), np.searchsorted(column[by_column], np.arange(len(used)))
        at_row, value_row, at_column, value_column = column[by_row], value[by_row], row[by_column], value[by_column]
        classes = len(self.classes)
        weight, bias = np.zeros((classes, len(used)), np.float32), np.zeros(classes)
        speed, bias_speed = np.zeros_like(weight), np.zeros(classes)
        share = (1 / (np.bincount(labels, minlength=classes)[labels] * classes)).astype(np.float32)
        target = np.eye(classes)[labels]
        for _ in range(rounds):
            z = np.stack([np.add.reduceat(weight[c][at_row] * value_row, row_starts) for c in range(classes)], 1) + bias
            z = np.exp(z - z.max(1, keepdims=True))
            error = ((z / z.sum(1, keepdims=True) - target) * share[:, None]).astype(np.float32)
            gradient = np.stack([np.add.reduceat(error[:, c][at_column] * value_column, column_starts) for c in range(classes)]) + decay * weight
            speed = 0.9 * speed - step * gradient
            bias_speed = 0.9 * bias_speed - step * error.sum(0)
            weight += speed
            bias += bias_speed
        self.weights[used] = weight.T
        self.bias = bias
        return self


def level(repeated: np.ndarray) -> np.ndarray:
    return np.minimum((repeated * LEVELS).astype(np.int64), LEVELS - 1)
