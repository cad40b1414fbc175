"""An averaged perceptron over sparse string features."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable, Sequence


class AveragedPerceptron:
    """Scores the allowed classes of an example by the sum of its features' weights; weights are averaged over all updates."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}

    def scores(self, features: Iterable[str], classes: Sequence[str]) -> dict[str, float]:
        out = dict.fromkeys(classes, 0.0)
        for f in features:
            row = self.weights.get(f)
            if row:
                for c in classes:
                    out[c] += row.get(c, 0.0)
        return out

    def predict(self, features: Iterable[str], classes: Sequence[str]) -> str:
        """The best class; the first of equal ones."""
        scores = self.scores(features, classes)
        return max(classes, key=lambda c: scores[c])

    def train(self, examples: list[tuple[list[str], Sequence[str], str]], rounds: int = 8, seed: int = 7) -> AveragedPerceptron:
        """examples: (features, allowed classes, right class)."""
        weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        totals: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        now, order = 0, list(range(len(examples)))
        rng = random.Random(seed)
        self.weights = weights
        for _ in range(rounds):
            rng.shuffle(order)
            for i in order:
                features, classes, right = examples[i]
                now += 1
                guess = self.predict(features, classes)
                if guess != right:
                    for f in features:
                        for c, step in ((right, 1.0), (guess, -1.0)):
                            weights[f][c] += step
                            totals[f][c] += now * step
        self.weights = {f: {c: w - totals[f][c] / max(now, 1) for c, w in row.items()} for f, row in weights.items()}
        return self
