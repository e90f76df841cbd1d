"""An averaged perceptron over sets of named features, for the small models that are trained here."""

from __future__ import annotations

import random


class AveragedPerceptron:
    """Several classes, one weight for each class and feature; weights are averaged over all steps of training."""

    def __init__(self, classes: list[str]):
        self.classes, self.weights = classes, {}

    def scores(self, features) -> list[float]:
        out = [0.0] * len(self.classes)
        for f in features:
            w = self.weights.get(f)
            if w:
                for i, x in enumerate(w):
                    out[i] += x
        return out

    def predict(self, features) -> str:
        s = self.scores(features)
        return self.classes[max(range(len(s)), key=lambda i: (s[i], -i))]

    def fit(self, rows: list[tuple[tuple, str]], rounds: int = 6, seed: int = 1) -> AveragedPerceptron:
        order, rng, step = list(range(len(rows))), random.Random(seed), 0
        total: dict = {}
        n = len(self.classes)
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                features, right = rows[k]
                step += 1
                guess = self.predict(features)
                if guess == right:
                    continue
                a, b = self.classes.index(right), self.classes.index(guess)
                for f in features:
                    w, t = self.weights.setdefault(f, [0.0] * n), total.setdefault(f, [0.0] * n)
                    w[a] += 1
                    w[b] -= 1
                    t[a] += step
                    t[b] -= step
        if step:
            self.weights = {f: [x - y / (step + 1) for x, y in zip(w, total[f])] for f, w in self.weights.items()}
        return self
