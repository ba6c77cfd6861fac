"""Monotone fits of short arrays (histograms), on the driver."""

from __future__ import annotations

import numpy as np


def isotonic(y: np.ndarray, w: np.ndarray | None = None, ascending: bool = True) -> np.ndarray:
    """The monotone sequence nearest to y by weighted squares: pools adjacent violators."""
    y = np.asarray(y, float)
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    if not ascending:
        return isotonic(y[::-1], w[::-1])[::-1]
    value, weight, size = [], [], []
    for a, b in zip(y, w):
        value.append(a)
        weight.append(b)
        size.append(1)
        while len(value) > 1 and value[-2] > value[-1]:
            total = weight[-2] + weight[-1]
            value[-2] = (value[-2] * weight[-2] + value[-1] * weight[-1]) / total if total else (value[-2] + value[-1]) / 2
            weight[-2] = total
            size[-2] += size[-1]
            del value[-1], weight[-1], size[-1]
    return np.repeat(value, size)


def running(y: np.ndarray, ascending: bool = True, backwards: bool = False) -> np.ndarray:
    """The running maximum (ascending) or minimum from the front; from the back the other way round, so that the result has that order."""
    y = np.asarray(y, float)
    if backwards:
        return (np.minimum if ascending else np.maximum).accumulate(y[::-1])[::-1]
    return (np.maximum if ascending else np.minimum).accumulate(y)


def monotone_mean(y: np.ndarray, ascending: bool = True) -> np.ndarray:
    """The best mixture, by squares, of the running extremes from both ends."""
    y = np.asarray(y, float)
    a, b = running(y, ascending), running(y, ascending, True)
    d = a - b
    alpha = 0.5 if not np.any(d) else float(np.clip(np.dot(y - b, d) / np.dot(d, d), 0, 1))
    return alpha * a + (1 - alpha) * b


def monotone_rates(n: np.ndarray, k: np.ndarray, ascending: bool = False, weight_exponent: float = -1.0) -> np.ndarray:
    """Monotone rates p >= 0 that minimise the sum of n ** exponent * (n p - k) ** 2.

    Empty bins have no evidence: they take the line between their neighbours; before the first evidence from 0 where the order begins low,
    after the last one the last value.
    """
    n, k = np.asarray(n, float), np.asarray(k, float)
    if not ascending:
        return monotone_rates(n[::-1], k[::-1], True, weight_exponent)[::-1]
    full = np.flatnonzero(n > 0)
    if not len(full):
        return np.zeros(len(n))
    p = np.maximum(isotonic(k[full] / n[full], n[full] ** (2 + weight_exponent)), 0)
    return np.interp(np.arange(len(n)), np.concatenate([[-1], full]), np.concatenate([[0.0], p]))
