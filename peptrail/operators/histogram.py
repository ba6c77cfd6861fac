"""Target-decoy histograms and lookups in them: a histogram is one aggregate of at most a few hundred rows, whatever the input."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins that a histogram may have; the aggregate that comes to the driver is no larger.
MOST_BINS = 1_000_000


@dataclass(frozen=True)
class Histogram:
    lo: float
    hi: float
    targets: list[int]
    decoys: list[int]

    @property
    def n(self) -> int:
        return len(self.targets)

    @property
    def width(self) -> float:
        return (self.hi - self.lo) / self.n

    @property
    def centres(self) -> np.ndarray:
        e = np.linspace(self.lo, self.hi, self.n + 1)
        return (e[1:] + e[:-1]) / 2

    def density(self, decoys: bool = False) -> np.ndarray:
        c = np.asarray(self.decoys if decoys else self.targets, float)
        return c / (self.width * max(c.sum(), 1.0))


def score_statistics(df: DataFrame, score: str, parts: list[str] | None = None) -> DataFrame:
    """(n, min, max, sum, mean, var, sd) of a column; nulls don't count, the variance of fewer than two values is 0."""
    c = F.col(score).cast("double")
    return df.groupBy(*(parts or [])).agg(
        F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.avg(c).alias("mean"),
        F.coalesce(F.var_samp(c), F.lit(0.0)).alias("var"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"),
    )


def bin_count(n: int, lo: float, hi: float, sd: float, rule: str | int = "scott", clip: tuple[int, int] | None = None) -> int:
    """Number of bins by a published rule for the bin width (scott, sturges, terrell_scott; auto is scott) or as given."""
    if isinstance(rule, int):
        k = rule
    else:
        widths = {
            "scott": lambda: (24 * math.sqrt(math.pi)) ** (1 / 3) * sd * n ** (-1 / 3),
            "sturges": lambda: (hi - lo) / (math.log2(n) + 1),
            "terrell_scott": lambda: (hi - lo) / math.ceil((2 * n) ** (1 / 3)),
        }
        if (rule := "scott" if rule == "auto" else rule) not in widths:
            raise ValueError(f"unknown rule for bins: {rule}")
        width = widths[rule]() if hi > lo else 0.0
        k = math.ceil((hi - lo) / width) if width > 0 else 1
    if clip:
        k = min(max(k, clip[0]), clip[1])
    if k > MOST_BINS:
        raise ValueError(f"the rule gives {k} bins, more than {MOST_BINS}; clip them, or give their number")
    return max(1, k)


def bin_edges(df: DataFrame, score: str, rule: str | int = "scott", clip: tuple[int, int] | None = None, extend: bool = False) -> np.ndarray:
    """Equal-width edges from the least to the greatest value; ``extend`` adds half a bin on either side."""
    r = score_statistics(df, score).first()
    if not r["n"]:
        return np.zeros(0)
    k = bin_count(r["n"], r["min"], r["max"], r["sd"], rule, clip)
    lo, hi = r["min"], r["max"]
    if extend:  # the outermost bins are centred on the least and the greatest value
        k = bin_count(0, lo, hi, 0.0, k + 1, clip)
        margin = 0.5 * (hi - lo) / (k - 1) if k > 1 else 0.5
        lo, hi = lo - margin, hi + margin
    return np.linspace(lo, hi, k + 1)


def bin_of(x: Column, lo: float, hi: float, n: int) -> Column:
    """The bin from 0; the last one includes its right edge; null outside."""
    k = F.least(F.floor((x - lo) / ((hi - lo) / n if hi > lo else 1.0)), F.lit(n - 1)).cast("int")
    return F.when((x >= lo) & (x <= hi), k)


def histogram_rows(df: DataFrame, score: str, target: str, lo: float, hi: float, n: int, parts: list[str] | None = None) -> DataFrame:
    """(parts, bin, targets, decoys) of the bins that aren't empty."""
    from peptrail.operators.qvalues import as_target

    y = as_target(F.col(target), df.schema[target].dataType.simpleString())
    binned = df.select(*(parts or []), bin_of(F.col(score).cast("double"), lo, hi, n).alias("bin"), y.alias("_y")).where("bin is not null and _y is not null")
    return binned.groupBy(*(parts or []), "bin").agg(F.count_if(F.col("_y")).alias("targets"), F.count_if(~F.col("_y")).alias("decoys"))


def histogram(df: DataFrame, score: str, target: str, rule: str | int = "scott", clip: tuple[int, int] | None = None) -> Histogram | None:
    """The histogram of targets and decoys over all scores, in two passes; None without any score."""
    edges = bin_edges(df, score, rule, clip)
    if not len(edges):
        return None
    n, lo, hi = len(edges) - 1, float(edges[0]), float(edges[-1])
    t, d = [0] * n, [0] * n
    for r in histogram_rows(df, score, target, lo, hi, n).collect():
        t[r["bin"]], d[r["bin"]] = r["targets"], r["decoys"]
    return Histogram(lo, hi if hi > lo else lo + 1.0, t, d)


def interpolate(x: Column, x0: float, width: float, values: list[float] | np.ndarray) -> Column:
    """Linear interpolation in values at x0, x0 + width, ...; the end values hold beyond. Stays in the JVM. Null and NaN give null."""
    v = F.array(*[F.lit(float(y)) for y in values])
    at = F.least(F.greatest((x - x0) / width, F.lit(0.0)), F.lit(float(len(values) - 1)))
    k = F.least(F.floor(at), F.lit(max(len(values) - 2, 0))).cast("int")
    a, b = F.element_at(v, k + 1), F.element_at(v, F.least(k + 2, F.lit(len(values))))
    return F.when(x.isNotNull() & ~F.isnan(x), a + (b - a) * (at - k))


def gaussian_iqr(mean: float, sd: float) -> tuple[float, float]:
    """The quartiles of a normal distribution."""
    d = NormalDist(mean, sd) if sd > 0 else None
    return (d.inv_cdf(0.25), d.inv_cdf(0.75)) if d else (mean, mean)
