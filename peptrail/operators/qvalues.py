"""Q-values: the expected share of false targets among all targets that score at least as well.

All of them aggregate rows by score first, so that windows see distinct scores only, and take running counts by a two-phase scan.
``parts`` computes several independent sets of q-values at once (levels, features): one job instead of one a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptrail.operators.histogram import Histogram, histogram, interpolate
from peptrail.operators.prefix import BUCKET, bucketed, scan

_INF = float("inf")


def as_target(target: Column, kind: str) -> Column:
    """A target column as boolean: booleans pass; 0/1 and -1/1, also as strings, are coerced; anything else is an error."""
    if kind == "boolean":
        return target
    number = target.try_cast("double") if kind == "string" else target.cast("double")
    return F.when(number == 1, True).when(number.isin(0.0, -1.0), False).when(target.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a target label: "), target.cast("string"))))


def coerce_target(df: DataFrame, target: str) -> DataFrame:
    """df with ``target`` as boolean; the values must be exactly {0, 1}, {-1, 1} or booleans, or ValueError is raised.

    The distinct labels are looked at first, at most four of them.
    """
    kind = df.schema[target].dataType.simpleString()
    if kind != "boolean":
        seen = {r[0] for r in df.select(F.col(f"`{target}`").cast("string").try_cast("double")).distinct().limit(4).collect()}
        if seen not in ({0.0, 1.0}, {-1.0, 1.0}):
            raise ValueError(f"labels of {target} must be 0 and 1, or -1 and 1, not {sorted(map(str, seen))}")
    return df.withColumn(target, as_target(F.col(f"`{target}`"), kind))


def _counts(df: DataFrame, score: Column, target: Column, parts: list[str]) -> DataFrame:
    checked = F.when(F.isnan(score), F.raise_error(F.lit("scores must not be NaN"))).otherwise(score)
    rows = df.select(*parts, checked.alias("_s"), target.alias("_y")).where("_s is not null and _y is not null")
    return rows.groupBy(*parts, "_s").agg(F.count_if(F.col("_y")).alias("_t"), F.count_if(~F.col("_y")).alias("_d"))


def _attach(df: DataFrame, found: DataFrame, score: Column, parts: list[str], out: str) -> DataFrame:
    keyed = df.withColumn("_s", score)
    return keyed.join(found.select(*parts, "_s", F.col("_q").alias(out)), [*parts, "_s"], "left").drop("_s")


def tdc_table(df: DataFrame, score: str, target: str, descending: bool = True, parts: list[str] | None = None) -> DataFrame:
    """(parts, _s, _t, _d, _q) of each distinct score (as float): counts and q-values by target-decoy competition."""
    parts = parts or []
    y = as_target(F.col(target), df.schema[target].dataType.simpleString())
    c = scan(bucketed(_counts(df, F.col(score).cast("float"), y, parts), parts, "_s"), parts, "_s", descending, {"_ct": ("sum", "_t"), "_cd": ("sum", "_d")})
    one = F.lit(1.0)
    # within a tie decoys come first, so the rate is lowest before its first decoy's successor or at its end
    last = F.when(F.col("_ct") > 0, (F.col("_cd") + 1) / F.col("_ct").cast("double")).otherwise(one)
    before = F.col("_ct") - F.col("_t")
    first = F.when((F.col("_d") > 0) & (before > 0), (F.col("_cd") - F.col("_d") + 2) / F.when(before > 0, before).cast("double")).otherwise(one)
    rated = c.withColumn("_f", F.least(one, last, first).cast("float"))
    least = scan(rated, parts, "_s", not descending, {"_m": ("min", "_f")})
    q = F.when(F.col("_m") == F.col("_w"), F.lit(1.0)).otherwise(F.col("_m").cast("double")).alias("_q")
    if BUCKET not in rated.columns:
        order = F.col("_s").asc() if descending else F.col("_s").desc()
        w = Window.partitionBy(*(parts or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = rated.select("*", F.min("_f").over(w).alias("_m"), F.first("_f").over(w).alias("_w"))
        return both.select(*parts, "_s", "_t", "_d", q)
    worst = rated.groupBy(*parts).agg((F.min_by if descending else F.max_by)("_f", "_s").alias("_w"))
    if not parts:
        least, worst = least.withColumn("_all", F.lit(0)), worst.withColumn("_all", F.lit(0))
    joined = least.join(F.broadcast(worst), parts or ["_all"])
    return joined.select(*parts, "_s", "_t", "_d", q)


def tdc(df: DataFrame, score: str, target: str, descending: bool = True, parts: list[str] | None = None, out: str = "q_value") -> DataFrame:
    """df with q-values by target-decoy competition: (decoys + 1) / targets down to each score, made monotone.

    Scores are compared as 4-byte floats; within a tie decoys come first and all rows get the tie's least value; rows whose value equals
    the worst score's get 1. ``target`` is boolean, 0/1 or -1/1. A null score or target gets a null q-value and doesn't count; NaN is an
    error; an empty table stays empty. Without targets all are 1.
    """
    table = tdc_table(df, score, target, descending, parts)
    return _attach(df, table, F.col(score).cast("float"), parts or [], out)


def from_counts(df: DataFrame, score: str, target: str, descending: bool = True, is_tdc: bool = True, pi0: float = 1.0, parts: list[str] | None = None, out: str = "q_value") -> DataFrame:
    """df with q-values factor * (decoys + 1) / max(targets, 1) at the end of each tie, made monotone and clipped to [0, 1].

    The factor is 1 after competition, else pi0 * targets / decoys of the whole set. Nulls as in ``tdc``.
    """
    parts = parts or []
    y = as_target(F.col(target), df.schema[target].dataType.simpleString())
    counts = _counts(df, F.col(score).cast("double"), y, parts)
    c = scan(bucketed(counts, parts, "_s"), parts, "_s", descending, {"_ct": ("sum", "_t"), "_cd": ("sum", "_d")})
    factor = F.lit(1.0)
    if not is_tdc:
        total = counts.groupBy(*parts).agg((F.lit(pi0) * F.try_divide(F.sum("_t"), F.sum("_d"))).alias("_k"))
        keys = parts or ["_all"]
        if not parts:
            c, total = c.withColumn("_all", F.lit(0)), total.withColumn("_all", F.lit(0))
        c, factor = c.join(F.broadcast(total), keys), F.col("_k")
    rated = c.withColumn("_f", factor * (F.col("_cd") + 1) / F.greatest(F.col("_ct"), F.lit(1)))
    least = scan(rated, parts, "_s", not descending, {"_m": ("min", "_f")})
    return _attach(df, least.withColumn("_q", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "_m"))), F.col(score).cast("double"), parts, out)


def from_peps(df: DataFrame, score: str, target: str, pep: str, out: str = "q_value") -> DataFrame:
    """df with q-values as the running mean of the targets' error probabilities, made monotone.

    A decoy's value is interpolated between the target scores around it; beyond them it takes the nearest one's. Nulls as in ``tdc``.
    """
    y = as_target(F.col(target), df.schema[target].dataType.simpleString())
    rows = df.select(F.col(score).cast("double").alias("_s"), y.alias("_y"), F.col(pep).cast("double").alias("_p")).where("_s is not null and _y is not null")
    points = rows.groupBy("_s").agg(F.coalesce(F.sum(F.when(F.col("_y"), F.col("_p"))), F.lit(0.0)).alias("_p"), F.count_if(F.col("_y")).alias("_n"))
    b = bucketed(points, [], "_s")
    mean = scan(b, [], "_s", True, {"_cp": ("sum", "_p"), "_cn": ("sum", "_n")}).withColumn("_f", F.when(F.col("_n") > 0, F.col("_cp") / F.col("_cn")))
    least = scan(mean, [], "_s", False, {"_m": ("min", "_f")})
    # neighbours among target scores: the last one below, the first one above
    at = F.when(F.col("_n") > 0, F.struct("_s", "_m"))
    near = scan(scan(least.withColumn("_k", at), [], "_s", False, {"_lo": ("max", "_k")}), [], "_s", True, {"_hi": ("min", "_k")})
    slope = (F.col("_hi._m") - F.col("_lo._m")) * F.try_divide(F.col("_s") - F.col("_lo._s"), F.col("_hi._s") - F.col("_lo._s"))
    q = F.when(F.col("_lo").isNull(), F.col("_hi._m")).when(F.col("_hi").isNull(), F.col("_lo._m")).otherwise(F.col("_lo._m") + F.coalesce(slope, F.lit(0.0)))
    return _attach(df, near.withColumn("_q", q), F.col(score).cast("double"), [], out)


def curve_from_histogram(h: Histogram, is_tdc: bool = True, pi0: float | None = None) -> list[float]:
    """Q-values at the left edges of the bins, and 0 at the right end."""
    from peptrail.operators.peps import pi0_by_slope

    factor = 1.0 if is_tdc else (pi0 if pi0 is not None else pi0_by_slope(h.targets, h.decoys))
    out, t, d, least = [0.0] * h.n + [0.0], 0, 0, _INF
    rates = []
    for i in range(h.n - 1, -1, -1):
        t, d = t + h.targets[i], d + h.decoys[i]
        rates.append((i, min(1.0, max(0.0, factor * (d + 1) / max(t, 1)))))
    for i, r in reversed(rates):
        least = min(least, r)
        out[i] = least
    return out


def from_histogram(df: DataFrame, score: str, target: str, is_tdc: bool = True, bins: str | int = "scott", clip: tuple[int, int] | None = (50, 500), out: str = "q_value") -> DataFrame:
    """df with q-values interpolated between bin edges of a target-decoy histogram: two passes, no sort, for very large inputs.

    Within [50, 500] bins the values differ from the exact ones by the bins' width. Nulls as in ``tdc``.
    """
    h = histogram(df, score, target, bins, clip)
    return df.withColumn(out, F.lit(None).cast("double") if h is None else interpolate(F.col(score).cast("double"), h.lo, h.width, curve_from_histogram(h, is_tdc)))


METHODS = {"tdc": tdc, "from_counts": from_counts, "from_histogram": from_histogram}


def qvalues(df: DataFrame, score: str, target: str, method: str = "tdc", pep: str | None = None, **options: object) -> DataFrame:
    """Q-values by the method's name: tdc, from_counts, from_peps or from_histogram; another name is a ValueError."""
    if method == "from_peps":
        if pep is None:
            raise ValueError("from_peps needs the column of error probabilities")
        return from_peps(df, score, target, pep, **options)
    if method not in METHODS:
        raise ValueError(f"unknown q-value method {method}")
    return METHODS[method](df, score, target, **options)


def update_labels(df: DataFrame, score: str, target: str, eval_fdr: float = 0.01, descending: bool = True, out: str = "label") -> DataFrame:
    """df with 1 for targets at or below eval_fdr, 0 for other targets, -1 for decoys."""
    q = tdc(df, score, target, descending, out="_q_label")
    y = as_target(F.col(target), df.schema[target].dataType.simpleString())
    return q.withColumn(out, F.when(~y, -1).when(F.col("_q_label") <= eval_fdr, 1).otherwise(0)).drop("_q_label")


def training_rows(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Accepted targets and decoys with the class y = (label + 1) / 2."""
    return labelled.where(F.col(label) != 0).withColumn("y", ((F.col(label) + 1) / 2).cast("int"))


def discovery_curve(df: DataFrame, q_value: str = "q_value", target: str = "target") -> DataFrame:
    """(q_value, discoveries): targets at or below each q-value that occurs."""
    per = df.where(F.col(target) & F.col(q_value).isNotNull()).groupBy(F.col(q_value).alias("q_value")).agg(F.count(F.lit(1)).alias("n"))
    return scan(bucketed(per, [], "q_value"), [], "q_value", False, {"discoveries": ("sum", "n")}).select("q_value", "discoveries")
