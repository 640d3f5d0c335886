"""Follow-the-regularised-leader (proximal) for sparse logistic models of one or more classes."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Numbers of state (features x outputs) above which training keeps it in a file.
IN_MEMORY = 1 << 24


def _state(features: int, outputs: int) -> np.ndarray:
    if features * outputs <= IN_MEMORY:
        return np.zeros((features, outputs))
    with tempfile.TemporaryFile() as file:  # it goes with the array
        return np.memmap(file, float, "w+", shape=(features, outputs))


class Ftrl:
    """Per-coordinate learning rates, L1 and L2 penalties. One column of weights per output."""

    def __init__(self, features: int, outputs: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = _state(features, outputs)
        self.n = _state(features, outputs)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, values: np.ndarray, error: np.ndarray, w: np.ndarray) -> None:
        """``error``: prediction minus target of each output; ``w``: the weights it was made with."""
        gradient = values[:, None] * error[None, :]
        more = self.n[at] + gradient**2
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more


@dataclass
class SparseRows:
    """A matrix without its zeros: row i holds ``values[start[i]:start[i + 1]]`` in ``columns``."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of(cls, matrix: np.ndarray) -> SparseRows:
        i, j = np.nonzero(matrix)
        return cls(np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(matrix)))]), j.astype(np.int32), matrix[i, j], matrix.shape[1])

    @classmethod
    def joined(cls, parts: list[SparseRows]) -> SparseRows:
        """The rows of all parts, in order."""
        sizes = np.concatenate([np.diff(p.start) for p in parts])
        return cls(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([p.columns for p in parts]), np.concatenate([p.values for p in parts]), parts[0].width)

    def dot(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sum of the rows ``at`` times ``values``."""
        sizes = self.start[at + 1] - self.start[at]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - sizes), sizes)
        return np.bincount(self.columns[where], self.values[where] * np.repeat(values, sizes), minlength=self.width)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_binary(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, epochs: int, seed: int = 11, **rates) -> np.ndarray:
    """Weights of a logistic regression; every row is (distinct feature numbers, values)."""
    model, draw = Ftrl(features, 1, **rates), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            at, values = rows[i]
            w = model.weights(at)
            model.update(at, values, sigmoid(values @ w) - labels[i], w)
    return model.weights()[:, 0]


def train_multinomial(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, classes: int, epochs: int, seed: int = 13, **rates) -> SparseRows:
    """Weights (features x classes) of a multinomial logistic regression."""
    model, draw = Ftrl(features, classes, **rates), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            at, values = rows[i]
            w = model.weights(at)
            error = softmax(values @ w)
            error[labels[i]] -= 1.0
            model.update(at, values, error, w)
    block = max(1, IN_MEMORY // (8 * max(1, classes)))
    return SparseRows.joined([SparseRows.of(model.weights(slice(i, i + block))) for i in range(0, features, block)])


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood on held-back rows."""
    if not len(logits):
        return 1.0
    rows = np.arange(len(labels))
    grid = np.geomspace(0.05, 20.0, 241)
    loss = [-np.log(np.maximum(softmax(logits / t)[rows, labels], 1e-300)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
