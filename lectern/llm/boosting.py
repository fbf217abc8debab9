"""Gradient-boosted trees for two classes, over binned features."""

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of one depth stored as arrays; leaves hold log-odds. Each tree draws its share of the features from a fixed seed."""

    def __init__(self, cuts: list[np.ndarray], feature: np.ndarray, bound: np.ndarray, leaf: np.ndarray, start: float):
        self.cuts, self.feature, self.bound, self.leaf, self.start = cuts, feature, bound, leaf, start

    @staticmethod
    def _binned(x: np.ndarray, cuts) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.2, least: float = 5.0, penalty: float = 1.0, share: float = 1.0, seed: int = 1) -> "BoostedTrees":
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = cls._binned(x, cuts)
        n, width = b.shape
        inner = (1 << depth) - 1
        feature, bound, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.uint8), np.zeros((trees, inner + 1))
        mean = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        start = float(np.log(mean / (1 - mean)))
        draw = np.random.default_rng(seed)
        f = np.full(n, start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            at = np.zeros(n, np.int64)  # node within the level
            use = np.sort(draw.choice(width, max(1, int(width * share)), replace=False))  # features of this tree
            for d in range(depth):
                size, base = 1 << d, (1 << d) - 1
                best, best_f, best_b = np.zeros(size), np.zeros(size, np.int64), np.full(size, 255, np.int64)
                total_g, total_h = np.bincount(at, g, size), np.bincount(at, h, size)
                whole = total_g**2 / (total_h + penalty)
                for j in use:
                    key = at * BINS + b[:, j]
                    gl = np.cumsum(np.bincount(key, g, size * BINS).reshape(size, BINS), axis=1)[:, :-1]
                    hl = np.cumsum(np.bincount(key, h, size * BINS).reshape(size, BINS), axis=1)[:, :-1]
                    gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - whole[:, None]
                    gain[(hl < least * 0.05) | (hr < least * 0.05)] = 0
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(size), top] > best + 1e-9
                    best[better], best_f[better], best_b[better] = gain[np.arange(size), top][better], j, top[better]
                feature[t, base : base + size], bound[t, base : base + size] = best_f, best_b
                at = 2 * at + (b[np.arange(n), best_f[at]] > best_b[at])
            leaf[t] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + penalty)
            f += leaf[t][at]
        return cls(cuts, feature, bound, leaf, start)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x, self.cuts)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        out = np.full(len(x), self.start)
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(x), np.int64)
            for d in range(depth):
                node = at + (1 << d) - 1
                at = 2 * at + (b[rows, feature[node]] > bound[node])
            out += leaf[at]
        return out
