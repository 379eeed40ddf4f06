"""Logistic regression on the driver, for the bounded samples that classifiers are fitted on."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 40, start: np.ndarray | None = None) -> np.ndarray:
    """Weights, the intercept last, by Newton steps; the ridge leaves the intercept free. No rows: all zero, or ``start``."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    beta = np.zeros(x.shape[1]) if start is None else start.copy()
    if not len(x):
        return beta
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = probability(x @ beta)
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def value(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
