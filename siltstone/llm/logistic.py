"""Logistic regression in numpy, for bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([l2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_sparse(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, l2: float, swaps: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Weights of `width` binary features and, last, the intercept, by accelerated gradient descent.

    row, col: where features are present. swaps (pair, col, sign): differences between rows and their counterfactual twins; the loss
    gains (w . difference)^2 for each pair, times the pair's weight.
    """
    n, (pair, swapped, sign) = len(y), swaps
    pairs = len(weight) if len(pair) else 0
    degree = np.bincount(row, minlength=n).max() + 1 if len(row) else 1
    stiff = np.bincount(swapped, weight[pair], width).max() if pairs else 0.0
    rate = 1 / (0.25 * degree * n * 0.05 + l2 + 4 * stiff)
    w = np.zeros(width + 1)
    ahead, momentum = w.copy(), 1.0
    last = np.inf
    for _ in range(rounds):
        z = np.bincount(row, ahead[col], n) + ahead[-1]
        error = sigmoid(z) - y
        grad = np.append(np.bincount(col, error[row], width) + l2 * ahead[:-1], error.sum())
        loss = np.logaddexp(0, np.where(y > 0, -z, z)).sum() + l2 / 2 * (ahead[:-1] ** 2).sum()
        if pairs:
            d = np.bincount(pair, sign * ahead[swapped], pairs)
            grad[:-1] += 2 * np.bincount(swapped, sign * (weight * d)[pair], width)
            loss += (weight * d**2).sum()
        if not loss <= last * 1.02 + 1e-9:  # too far: start again from here with a shorter step
            rate, momentum, ahead, last = rate / 2, 1.0, w.copy(), np.inf
            continue
        last = loss
        new = ahead - rate * grad
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w
