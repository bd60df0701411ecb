"""Small numpy logistic models, trained on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights and, last, the intercept of an L2 logistic regression by damped Newton steps; the intercept isn't shrunk."""
    a = np.c_[x, np.ones(len(x))]
    w, weight = np.zeros(a.shape[1]), np.ones(len(x)) if weight is None else weight
    shrink = np.full(a.shape[1], l2)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ a + np.diag(shrink), a.T @ (weight * (p - y)) + shrink * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
