"""Regressors on small dense tables: boosted trees, a forest and ridge regression.

Each is fitted whole in one task, so that many fits (models by folds) run side by side;
what they are fitted on is bounded by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 255


def _bins(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each value's bin, and for each column the values between bins."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
        cuts.append((values[1:] + values[:-1]) / 2)
    return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1) if x.shape[1] else np.zeros((len(x), 0), int), cuts


class Tree:
    """Splits for the least squared error. Nodes are (column, cut, below, above), leaves are numbers."""

    def __init__(self, binned: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, rows: np.ndarray, depth: int):
        self.gain = np.zeros(binned.shape[1])
        self.width = BINS + 1
        self.root = self._grow(binned, cuts, y, rows, depth)

    def _grow(self, binned, cuts, y, rows, depth):
        mean, n = float(y[rows].mean()), len(rows)
        columns = binned.shape[1]
        if depth == 0 or n < 2 or not columns or np.ptp(y[rows]) == 0:
            return mean
        at = (binned[rows] + np.arange(columns) * self.width).ravel()
        count = np.bincount(at, minlength=columns * self.width).reshape(columns, -1).cumsum(1)[:, :-1]
        total = np.bincount(at, np.repeat(y[rows] - mean, columns), columns * self.width).reshape(columns, -1).cumsum(1)[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((count > 0) & (count < n), total**2 / count + total**2 / (n - count), 0.0)
        k, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[k, b] <= 1e-12:
            return mean
        self.gain[k] += gain[k, b]
        below = binned[rows, k] <= b
        return int(k), float(cuts[k][b]), self._grow(binned, cuts, y, rows[below], depth - 1), self._grow(binned, cuts, y, rows[~below], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(x)), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, float):
                out[rows] = node
                continue
            k, cut, a, b = node
            below = x[rows, k] <= cut
            todo += [(a, rows[below]), (b, rows[~below])]
        return out


@dataclass
class Trees:
    """start + rate times the sum (or, for a forest, the mean) of trees."""

    start: float
    rate: float
    trees: list[Tree]
    columns: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    @property
    def importances(self) -> np.ndarray:
        """Each column's share of what the trees' splits gain; trees count alike."""
        shares = [t.gain / t.gain.sum() for t in self.trees if t.gain.sum() > 0]
        return np.mean(shares, 0) if shares else np.zeros(self.columns)


@dataclass
class BoostedTrees:
    rounds: int = 200
    rate: float = 0.05
    depth: int = 3
    sample: float = 0.8
    seed: int = 42

    def setMaxIter(self, n: int) -> BoostedTrees:  # noqa: N802
        self.rounds = n
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rng, (binned, cuts) = np.random.default_rng(self.seed), _bins(x)
        start = float(y.mean())
        rest, trees, some = y - start, [], max(1, int(self.sample * len(y)))
        for _ in range(self.rounds):
            tree = Tree(binned, cuts, rest, rng.permutation(len(y))[:some], self.depth)
            trees.append(tree)
            rest = rest - self.rate * tree.predict(x)
        return Trees(start, self.rate, trees, x.shape[1])


@dataclass
class Forest:
    trees: int = 200
    depth: int = 4
    seed: int = 42

    def setNumTrees(self, n: int) -> Forest:  # noqa: N802
        self.trees = n
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rng, (binned, cuts) = np.random.default_rng(self.seed), _bins(x)
        trees = [Tree(binned, cuts, y, rng.integers(0, len(y), len(y)), self.depth) for _ in range(self.trees)]
        return Trees(0.0, 1 / max(1, self.trees), trees, x.shape[1])


@dataclass
class Linear:
    weights: np.ndarray
    start: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.start

    @property
    def importances(self) -> np.ndarray:
        return np.abs(self.weights)


@dataclass
class Ridge:
    alpha: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Linear:
        mean, level = x.mean(0), float(y.mean())
        c = x - mean
        w = np.linalg.solve(c.T @ c + self.alpha * np.eye(x.shape[1]), c.T @ (y - level)) if x.shape[1] else np.zeros(0)
        return Linear(w, level - float(mean @ w))


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Centres from one start, spread out by distance, and the sum of squared distances to them."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        far = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
    centres = np.array(centres)
    for _ in range(rounds):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres, rtol=0, atol=1e-9):
            break
        centres = new
    return centres, float(((x[:, None] - centres) ** 2).sum(2).min(1).sum())
