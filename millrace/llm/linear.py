"""Small linear-model tools in numpy: sparse rows, logistic regression, Platt scaling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Sparse:
    """Rows of (index, value); ``ptr[i]:ptr[i + 1]`` is row i."""

    ptr: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def take(self, which: np.ndarray) -> Sparse:
        parts = [slice(self.ptr[i], self.ptr[i + 1]) for i in which]
        ptr = np.concatenate(([0], np.cumsum([p.stop - p.start for p in parts]))).astype(np.int64)
        join = lambda a: np.concatenate([a[p] for p in parts]) if parts else a[:0]
        return Sparse(ptr, join(self.index), join(self.value))


def fit_logistic(x: Sparse, y: np.ndarray, dim: int, l2: float = 1e-6, rounds: int = 80, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch AdaGrad with equal class weight."""
    w, b = np.zeros(dim), 0.0
    gw, gb = np.full(dim, 1e-8), 1e-8
    rows = x.rows
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(rounds):
        z = np.bincount(rows, x.value * w[x.index], minlength=len(y)) + b
        error = (sigmoid(z) - y) * share
        grad = np.bincount(x.index, x.value * error[rows], minlength=dim) + l2 * w
        gw += grad * grad
        w -= rate * grad / np.sqrt(gw)
        gb += error.sum() ** 2
        b -= rate * error.sum() / np.sqrt(gb)
    return w, b


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """a and c with P(y = 1) = sigmoid(a z + c), by Newton's method on smoothed targets."""
    if not len(z) or len(np.unique(y)) < 2:
        return 1.0, 0.0
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(z).max()), 1e-9)
    u = np.stack([z / scale, np.ones(len(z))], 1)
    theta = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(u @ theta)
        g = u.T @ (p - t) + 1e-4 * theta
        h = (u * (p * (1 - p))[:, None]).T @ u + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0] / scale), float(theta[1])
