"""Linear models with squared hinge loss, many at once, by Newton steps over aggregated Gram matrices.

Each problem minimises |w|^2 / 2 + C sum c_i max(0, 1 - y_i w.x_i)^2, the bias being a penalised constant feature. A Newton step needs
only X'DX and X'Dy of the rows within the margin, d x d numbers: the rows stay where they are, every pass adds up small matrices in
the tasks, then in a tree, and the driver solves. All problems (folds, class weights, cross-validation parts) share each pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

@dataclass(frozen=True)
class Problem:
    """A key, by which the rows to learn from are told apart, and class weights."""

    key: tuple
    positive: float = 1.0
    negative: float = 1.0


def margin_terms(x: np.ndarray, y: np.ndarray, w: np.ndarray, positive: float, negative: float) -> tuple[np.ndarray, np.ndarray, float]:
    """X'DX, X'Dy and the loss of the rows within the margin; x has the constant 1 as its last column."""
    slack = 1 - y * (x @ w)
    on = slack > 0
    a, s = x[on], slack[on]
    c = np.where(y[on] > 0, positive, negative)
    return (a * c[:, None]).T @ a, a.T @ (c * y[on]), float(np.dot(c, s * s))


def newton(problems: list[Problem], d: int, aggregate: Callable[[dict[tuple, np.ndarray]], dict[tuple, tuple[np.ndarray, np.ndarray, float]]], cost: float = 1.0, steps: int = 30, tolerance: float = 1e-7, start: dict[tuple, np.ndarray] | None = None) -> dict[tuple, np.ndarray]:
    """Weights (bias last) of each problem; ``aggregate`` gives margin_terms at given weights for all problems in one pass.

    A step that doesn't lower the objective is halved. It ends where a step can gain no more than ``tolerance`` of the objective. ``start``: weights to begin with, such as those of the labels before.
    """
    w = {p.key: np.array((start or {}).get(p.key, np.zeros(d + 1))) for p in problems}
    good: dict[tuple, tuple[float, np.ndarray]] = {}
    live = set(w)
    for _ in range(steps):
        terms = aggregate({k: w[k] for k in live})
        for k in sorted(live):
            gram, right, loss = terms[k]
            value = 0.5 * w[k] @ w[k] + cost * loss
            if k in good and value > good[k][0] + 1e-12 * abs(good[k][0]):
                w[k] = (w[k] + good[k][1]) / 2
                if np.max(np.abs(w[k] - good[k][1])) < tolerance:
                    w[k] = good[k][1]
                    live.discard(k)
                continue
            done = k in good and good[k][0] - value <= tolerance * max(1.0, abs(value))
            good[k] = (value, w[k])
            if done:
                live.discard(k)
                continue
            hessian, goal = np.eye(d + 1) + 2 * cost * gram, 2 * cost * right
            w[k] = np.linalg.solve(hessian, goal)
            move = w[k] - good[k][1]
            if 0.5 * move @ (hessian @ move) <= tolerance * max(1.0, abs(value)):  # what this step can gain
                good[k] = (value, w[k])
                live.discard(k)
        if not live:
            break
    return {k: good[k][1] for k in w}


def fit_local(x: np.ndarray, y: np.ndarray, positive: float = 1.0, negative: float = 1.0) -> np.ndarray:
    """One problem on rows in memory."""
    x = np.column_stack([x, np.ones(len(x))])
    p = Problem((0,), positive, negative)
    return newton([p], x.shape[1] - 1, lambda w: {(0,): margin_terms(x, y, w[(0,)], positive, negative)})[(0,)]
