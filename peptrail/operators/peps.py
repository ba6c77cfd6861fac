"""Posterior error probabilities: the chance that a target of a given score is false.

Every estimate is a curve over a histogram of at most a few hundred bins, fitted on the driver and looked up in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.operators.histogram import Histogram, histogram, interpolate, score_statistics
from peptrail.operators.isotonic import isotonic, monotone_rates
from peptrail.operators.qvalues import as_target

#: Bins from which densities and splines are estimated.
FINE_BINS = 500


def pi0_by_slope(target: list | np.ndarray, decoy: list | np.ndarray, threshold: float = 0.9) -> float:
    """The share of false targets: slope of target against decoy density left of the decoys' first bin at 90 % of their maximum."""
    t, d = np.asarray(target, float), np.asarray(decoy, float)
    if not len(d) or d.max() <= 0:
        return 1e-10
    last = int(np.argmax(d >= threshold * d.max()))
    x, y = d[:last], t[:last]
    if last < 2 or np.ptp(x) == 0:
        return 1e-10
    slope = np.dot(x - x.mean(), y - y.mean()) / np.dot(x - x.mean(), x - x.mean())
    return float(max(slope, 1e-10))


def trials(h: Histogram, is_tdc: bool = True, restrict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Targets and expected false targets in each bin; ``restrict`` keeps them whole and within the targets."""
    t, d = np.asarray(h.targets, float), np.asarray(h.decoys, float)
    k = (1.0 if is_tdc else pi0_by_slope(t, d)) * d
    if restrict:
        n = np.maximum(t, 1)
        return n, np.clip(np.ceil(k), 0, n)
    return t, k


def curve_hist(h: Histogram, is_tdc: bool = True, scale_to_one: bool = False, weight_exponent: float = -1.0) -> np.ndarray:
    """At the bin centres: a falling fit of expected false targets to targets."""
    n, k = trials(h, is_tdc)
    p = monotone_rates(n, k, False, weight_exponent)
    if scale_to_one and 0 < p[0] < 1:
        p = p / p[0]
    return np.clip(p, 0, 1)


def _smooth(counts: np.ndarray, width: float, values: np.ndarray) -> np.ndarray:
    """Gaussian kernel density at the bin centres, bandwidth by Scott's rule."""
    n = counts.sum()
    if n < 2:
        return np.zeros(len(counts))
    mean = np.dot(counts, values) / n
    sd = np.sqrt(np.dot(counts, (values - mean) ** 2) / (n - 1))
    band = max(sd * n ** (-1 / 5), width / 2)
    z = (values[:, None] - values[None, :]) / band
    return np.exp(-0.5 * z**2) @ counts / (n * band * np.sqrt(2 * np.pi))


def curve_kde(h: Histogram, is_tdc: bool = True) -> np.ndarray:
    """At the bin centres: from smooth densities of targets and decoys, made falling."""
    t, d = np.asarray(h.targets, float), np.asarray(h.decoys, float)
    pt, pd_ = _smooth(t, h.width, h.centres), _smooth(d, h.width, h.centres)
    factor = d.sum() / max(t.sum(), 1) if is_tdc else pi0_by_slope(pt, pd_)
    right = np.clip(pt - factor * pd_, 0, None)
    raw = np.clip(1 - np.divide(right, pt, out=np.zeros_like(pt), where=pt > 0), 0, 1)
    return np.clip(isotonic(raw, np.maximum(pt, 1e-300), False), 0, 1)


def curve_qvality(h: Histogram, is_tdc: bool = True, penalties: np.ndarray | None = None) -> np.ndarray:
    """At the bin centres: a logistic fit of decoy odds with a smoothness penalty on its second differences, made falling.

    The penalty with the least generalised cross-validation error is taken. Without decoys all are 0.
    """
    t, d = np.asarray(h.targets, float), np.asarray(h.decoys, float)
    if d.sum() == 0 or t.sum() == 0:
        return np.zeros(h.n)
    used = np.flatnonzero(t + d > 0)
    x, n, k = h.centres[used], (t + d)[used], d[used]
    m = len(used)
    if m < 4:
        return np.clip(monotone_rates(t, d), 0, 1)
    gap = np.diff(x) / h.width
    rows = np.zeros((m - 2, m))
    for i in range(m - 2):  # second divided differences of uneven points
        a, b = gap[i], gap[i + 1]
        rows[i, i : i + 3] = 2 / (a * (a + b)), -2 / (a * b), 2 / (b * (a + b))
    rough = rows.T @ rows
    best = (np.inf, np.zeros(m))
    for lam in penalties if penalties is not None else 10.0 ** np.arange(-1, 7):
        g = np.full(m, np.log(k.sum() / max(n.sum() - k.sum(), 1)))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            weight = np.maximum(n * p * (1 - p), 1e-9)
            z = g + (k - n * p) / weight
            inner = np.linalg.inv(np.diag(weight) + lam * rough)
            new = np.clip(inner @ (weight * z), -30, 30)
            done = np.max(np.abs(new - g)) < 1e-6
            g = new
            if done:
                break
        trace = float(np.sum(np.diag(inner) * weight))
        error = float(np.sum(weight * (z - g) ** 2)) * m / max(m - trace, 1e-9) ** 2
        if error < best[0]:
            best = (error, g)
    odds = np.exp(np.clip(best[1], -30, 30))  # decoys against targets
    scale = 1.0 if is_tdc else pi0_by_slope(h.density(), h.density(True)) * t.sum() / d.sum()
    p = isotonic(np.clip(odds * scale, 0, 1), n, False)
    return np.clip(np.interp(h.centres, x, p), 0, 1)


CURVES = {"qvality": curve_qvality, "hist_nnls": curve_hist, "kde_nnls": curve_kde}


def peps(df: DataFrame, score: str, target: str, method: str = "qvality", is_tdc: bool = True, peps_error: bool = False, out: str = "pep") -> DataFrame:
    """df with error probabilities by the method's name: qvality, hist_nnls or kde_nnls; higher scores are better.

    Null scores get null. An empty table stays empty. ``peps_error``: a ValueError if all probabilities are 1.
    """
    if method == "qvality_bin":
        raise ValueError("qvality_bin calls a program that isn't part of this package; qvality fits the same kind of curve")
    if method not in CURVES:
        raise ValueError(f"unknown method for error probabilities: {method}")
    h = histogram(df, score, target, "scott" if method == "hist_nnls" else FINE_BINS)
    if h is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    curve = CURVES[method](h, is_tdc)
    if peps_error and np.all(curve >= 1):
        raise ValueError("all error probabilities are 1")
    return df.withColumn(out, interpolate(F.col(score).cast("double"), h.lo + h.width / 2, h.width, curve))


def pi0_slope(df: DataFrame, score: str, target: str, bins: int = 50, threshold: float = 0.9) -> DataFrame:
    """(pi0): pi0_by_slope in SQL, over an equal-width histogram of counts."""
    y = as_target(F.col(target), df.schema[target].dataType.simpleString())
    r = score_statistics(df, score).first()
    from peptrail.operators.histogram import bin_of

    k = df.select(bin_of(F.col(score).cast("double"), r["min"], r["max"], bins).alias("bin"), y.alias("y")).groupBy("bin").agg(F.count_if(F.col("y")).alias("t"), F.count_if(~F.col("y")).alias("d"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(k, "bin", "left").na.fill(0)
    top = every.agg(F.max("d").alias("m")).withColumn("one", F.lit(1))
    marked = every.withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    first = marked.where(F.col("d") >= threshold * F.col("m")).groupBy("one").agg(F.min("bin").alias("last"))
    return marked.join(F.broadcast(first), "one").where("bin < last").agg(F.greatest(F.regr_slope("t", "d"), F.lit(1e-10)).alias("pi0"))
