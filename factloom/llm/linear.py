"""Sparse multinomial logistic regression by follow-the-regularised-leader, and temperature calibration."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal with elastic-net penalties; rows are (feature indices, values)."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.bias = np.zeros(classes)
        self._bias_n = np.zeros(classes)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 4, seed: int = 7) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                at, x = rows[k]
                w = self.weights(at)
                g = softmax(x @ w + self.bias)
                g[target[k]] -= 1.0
                self._bias_n += g * g
                self.bias -= self.alpha * g / (self.beta + np.sqrt(self._bias_n))
                grad = x[:, None] * g[None, :]
                n = self.n[at]
                after = n + grad * grad
                self.z[at] += grad - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
                self.n[at] = after
        return self


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature that minimises the negative log likelihood on rows kept out of the fit."""
    if not len(target):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(target)), target] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
