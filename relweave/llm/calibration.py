"""Logistic calibration on a bounded number of training rows."""

from __future__ import annotations

import numpy as np


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method on standardised features; returns weights for the raw ones, the intercept last."""
    x = np.asarray(features, dtype=np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (labels - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    out = np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())
    return out


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))
