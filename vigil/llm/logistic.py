"""Logistic regression on bounded arrays: what the operators fit on samples of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method; ``ridge`` holds all but the constant back."""
    x = np.column_stack((x, np.ones(len(x)))).astype(float)
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + hold * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    s, r = score[order], np.empty(len(score))
    _, first, count = np.unique(s, return_index=True, return_counts=True)
    r[order] = np.repeat(first + (count + 1) / 2, count)
    n1 = int(y.sum())
    return float((r[y == 1].sum() - n1 * (n1 + 1) / 2) / max(n1 * (len(y) - n1), 1))
