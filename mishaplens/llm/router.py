"""Learned partitions of a vector space: a neighbour graph of a sample is cut into balanced parts, and a small classifier learns to tell them."""

from __future__ import annotations

import numpy as np


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows (cosine) of every row of unit vectors."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), "int32")
    for lo in range(0, n, 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        out[lo : lo + 1024] = np.argpartition(s, n - k, 1)[:, n - k :]
    return out


def _bisect(src, dst, n, rng):
    """Halve a graph of n nodes: a smooth function on it (power iteration) split at the median, then swaps that lessen the cut."""
    degree = np.maximum(np.bincount(src, minlength=n), 1)
    f = rng.standard_normal(n)
    for _ in range(30):
        f = 0.5 * f + 0.5 * np.bincount(src, f[dst], n) / degree
        f -= np.average(f, weights=degree)
        f /= np.linalg.norm(f) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(f, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        across = np.bincount(src, side[src] != side[dst], n)
        gain = 2 * across - degree
        a, b = np.flatnonzero(~side & (gain > 0)), np.flatnonzero(side & (gain > 0))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b)) // 2  # half of them, as neighbours that swap together gain nothing
        if not m:
            break
        side[a[:m]], side[b[:m]] = True, False
    return side


def balanced_parts(graph: np.ndarray, n_parts: int, seed: int = 0) -> np.ndarray:
    """Part of each node; parts differ by a node or so in size. ``n_parts`` is a power of two."""
    rng = np.random.default_rng(seed)
    n, k = graph.shape
    src = np.r_[np.repeat(np.arange(n), k), graph.ravel()]
    dst = np.r_[graph.ravel(), np.repeat(np.arange(n), k)]
    part = np.zeros(n, "int32")
    todo = [(np.arange(n), src, dst, n_parts, 0)]
    while todo:
        nodes, s, d, parts, base = todo.pop()
        if parts == 1 or len(nodes) < 2:
            part[nodes] = base
            continue
        side = _bisect(s, d, len(nodes), rng)
        for half, at in ((~side, base), (side, base + parts // 2)):
            new = np.cumsum(half) - 1
            keep = half[s] & half[d]
            todo.append((nodes[half], new[s[keep]], new[d[keep]], parts // 2, at))
    return part


class Router:
    """A classifier with one hidden layer; its most probable parts are where a vector is kept and looked for."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.weights = weights

    @classmethod
    def fit(cls, x, graph, part, n_parts, hidden=128, epochs=14, batch=256, rate=2e-3, spread=0.3, seed=0):
        """Soft labels: a row's own part and those of its neighbours. Each epoch sees the rows moved a little, so that near vectors get near answers."""
        rng = np.random.default_rng(seed)
        n, d = x.shape
        w = [
            (rng.standard_normal((d, hidden)) * np.sqrt(2 / d)).astype("f4"), np.zeros(hidden, "f4"),
            (rng.standard_normal((hidden, n_parts)) * np.sqrt(1 / hidden)).astype("f4"), np.zeros(n_parts, "f4"),
        ]
        m1, m2 = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        t, scale = 0, np.float32(np.sqrt(d))
        for epoch in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                i = order[lo : lo + batch]
                xb = x[i] + rng.standard_normal((len(i), d)).astype("f4") * np.float32(spread / np.sqrt(d))
                xb *= scale / np.linalg.norm(xb, axis=1, keepdims=True)
                y = np.zeros((len(i), n_parts), "f4")
                rows = np.arange(len(i))
                y[rows, part[i]] = 0.7
                for col in graph[i].T:
                    np.add.at(y, (rows, part[col]), np.float32(0.3 / graph.shape[1]))
                h = np.maximum(xb @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                g = (p - y) / len(i)
                gh = (g @ w[2].T) * (h > 0)
                grads = [xb.T @ gh, gh.sum(0), h.T @ g, g.sum(0)]
                t += 1
                step = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs))) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for j, gr in enumerate(grads):
                    m1[j] += 0.1 * (gr - m1[j])
                    m2[j] += 0.001 * (gr * gr - m2[j])
                    w[j] -= (step * m1[j] / (np.sqrt(m2[j]) + 1e-8)).astype("f4")
        return cls(w)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Unnormalised log probabilities of the parts for unit vectors."""
        w1, b1, w2, b2 = self.weights
        h = np.maximum((x * np.float32(np.sqrt(x.shape[1]))) @ w1 + b1, 0)
        return h @ w2 + b2
