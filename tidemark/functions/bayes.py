"""Gaussian naive Bayes sums as numpy arrays, for learners that keep several models in a task."""

from __future__ import annotations

import numpy as np


class Sums:
    """n, sum x, sum x^2 per class; leading axes may stack members."""

    __slots__ = ("n", "s", "q")

    def __init__(self, n, s, q):
        self.n, self.s, self.q = n, s, q

    @classmethod
    def zeros(cls, n_classes: int, d: int) -> "Sums":
        return cls(np.zeros(n_classes), np.zeros((n_classes, d)), np.zeros((n_classes, d)))

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, n_classes: int, weight: np.ndarray | None = None) -> "Sums":
        hot = np.eye(n_classes)[y] * (1.0 if weight is None else weight[:, None])
        return cls(hot.sum(axis=0), hot.T @ x, hot.T @ (x * x))

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(self.n + other.n, self.s + other.s, self.q + other.q)

    def __getstate__(self):
        return (self.n, self.s, self.q)

    def __setstate__(self, state):
        self.n, self.s, self.q = state

    @classmethod
    def stack(cls, many: list["Sums"]) -> "Sums":
        return cls(np.stack([m.n for m in many]), np.stack([m.s for m in many]), np.stack([m.q for m in many]))

    def model(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(constant, mean, variance) per class; the constant is -inf for a class without rows."""
        n = self.n[..., None]
        total = self.n.sum(axis=-1)[..., None]
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(n > 0, self.s / n, 0.0)
            var = np.where(n > 0, np.maximum(self.q / n - mean * mean, 0.0), 1.0)
            whole = self.q.sum(axis=-2) / total - (self.s.sum(axis=-2) / total) ** 2
            eps = np.maximum(np.nan_to_num(whole).max(axis=-1) * 1e-9, 1e-9)[..., None, None]
            var = var + eps
            const = np.log(self.n / total) - 0.5 * np.log(2 * np.pi * var).sum(axis=-1)
        return np.where(self.n > 0, const, -np.inf), mean, var

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """(..., rows, classes) log prior plus log likelihood."""
        const, mean, var = self.model()
        gap = x[:, None, :] - mean[..., None, :, :]
        return const[..., None, :] - 0.5 * (gap * gap / var[..., None, :, :]).sum(axis=-1)

    def proba(self, x: np.ndarray) -> np.ndarray:
        return shares(self.log_joint(x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.log_joint(x).argmax(axis=-1)


def joint_of_row(model: tuple, x: np.ndarray) -> np.ndarray:
    """(..., classes) log joint of one row under stacked models from ``Sums.model``."""
    const, mean, var = model
    gap = x - mean
    return const - 0.5 * (gap * gap / var).sum(axis=-1)


def shares(log_joint: np.ndarray) -> np.ndarray:
    """Probabilities along the last axis; equal when every class is impossible."""
    top = log_joint.max(axis=-1, keepdims=True)
    known = np.isfinite(top)
    e = np.where(known, np.exp(log_joint - np.where(known, top, 0.0)), 1.0)
    return e / e.sum(axis=-1, keepdims=True)
