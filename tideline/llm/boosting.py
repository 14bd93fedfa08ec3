"""Gradient-boosted trees over small integer features, fitted on counted cells and applied as SQL expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A split `feature <= cut` with a further split on either side; leaves left-left, left-right, right-left, right-right."""

    splits: tuple[tuple[int, int], tuple[int, int], tuple[int, int]]
    leaves: tuple[float, float, float, float]

    def value(self, x: tuple[int, ...]) -> float:
        (f, c), *rest = self.splits
        side = int(x[f] > c)
        g, d = rest[side]
        return self.leaves[2 * side + int(x[g] > d)]


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple[Tree, ...]

    def probability(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-self.base - sum(t.value(x) for t in self.trees)))

    def log_odds(self, features: list[Column]) -> Column:
        """The sum of all trees, as nested CASE expressions."""
        total = F.lit(self.base)
        for t in self.trees:
            (f, c), (g, d), (h, e) = t.splits
            left = F.when(features[g] <= d, t.leaves[0]).otherwise(t.leaves[1])
            right = F.when(features[h] <= e, t.leaves[2]).otherwise(t.leaves[3])
            total = total + F.when(features[f] <= c, left).otherwise(right)
        return total


#: A leaf's most log odds: where large counts meet a probability near 0 or 1, a Newton step has hardly a curvature and would overshoot.
STEP = 8.0
Cell = tuple[tuple[int, ...], float, float]  # features, rows, rows of class 1


def _best(rows: list[tuple[tuple[int, ...], float, float]]) -> tuple[tuple[int, int], float]:
    """The split of (features, gradient, curvature) rows that gains most; ties go to the first feature and cut."""
    g_all, h_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, gain = (0, 1 << 30), 0.0
    for f in range(len(rows[0][0]) if rows else 0):
        sums: dict[int, list[float]] = {}
        for x, g, h in rows:
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += g
            s[1] += h
        g_left = h_left = 0.0
        for cut in sorted(sums)[:-1]:
            g_left += sums[cut][0]
            h_left += sums[cut][1]
            now = g_left**2 / (h_left + 1) + (g_all - g_left) ** 2 / (h_all - h_left + 1) - g_all**2 / (h_all + 1)
            if now > gain + 1e-12:
                best, gain = (f, cut), now
    return best, gain


def fit(cells: list[Cell], rounds: int = 20, rate: float = 0.4) -> Model:
    """Newton boosting of the logistic loss on cells with counts; one class alone gives a constant."""
    total, ones = sum(c[1] for c in cells), sum(c[2] for c in cells)
    base = math.log((ones + 0.5) / (total - ones + 0.5))
    trees: list[Tree] = []
    scores = [base] * len(cells)
    if not cells or ones in (0, total):
        return Model(base, ())
    for _ in range(rounds):
        rows = []
        for (x, n, k), s in zip(cells, scores, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
            rows.append((x, k - n * p, n * p * (1 - p)))
        (f, c), gain = _best(rows)
        if gain <= 1e-6:
            break
        splits, leaves = [(f, c)], []
        for side in (False, True):
            own = [r for r in rows if (r[0][f] > c) == side]
            (g, d), _ = _best(own)
            splits.append((g, d))
            for low in (False, True):
                leaf = [r for r in own if (r[0][g] > d) == low]
                step = rate * sum(r[1] for r in leaf) / (sum(r[2] for r in leaf) + 1)
                leaves.append(max(-STEP, min(STEP, step)))
        tree = Tree(tuple(splits), tuple(leaves))
        trees.append(tree)
        scores = [s + tree.value(x) for s, (x, _, _) in zip(scores, cells, strict=True)]
    return Model(base, tuple(trees))


def threshold(model: Model, cells: list[Cell], precision: float, support: int) -> float | None:
    """The lowest probability, one half at least, above which class 1 makes up `precision` of `support` rows or more."""
    by = sorted(((model.probability(x), n, k) for x, n, k in cells), reverse=True)
    rows = ones = 0.0
    out = None
    for i, (p, n, k) in enumerate(by):
        if p < 0.5:
            break
        rows += n
        ones += k
        if i + 1 < len(by) and by[i + 1][0] == p:
            continue
        if rows >= support and ones >= precision * rows:
            out = p
    return out
