"""Running sums and minima over a global order, without a task that sees all rows of a large table.

By Catalyst's estimate of its size, a small table is scanned by a plain window; of a large one, rows are bucketed by approximate quantiles of the order column, scanned within their bucket, and shifted by the totals of the buckets
before. The quantiles only balance the work; they don't affect sums of whole numbers, minima or maxima. Running sums of doubles are added in
another order, so their last bits may differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptrail.session import UNKNOWN_BYTES, plan_bytes

BUCKET = "_bucket"
#: Estimated size up to which a plain window is used.
SMALL_BYTES = 128 << 20
#: Estimated size of a bucket, and the most buckets there can be: their offsets are broadcast, a few MB. Beyond that buckets grow.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 65_536
#: Cuts that are searched at once.
STEP = 256
_FN = {"sum": F.sum, "min": F.min, "max": F.max}
_COMBINE = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def bucketed(df: DataFrame, parts: list[str], value: str, buckets: int | None = None) -> DataFrame:
    """df with its bucket, or unchanged if it is small: equal values share one; each of the ``parts`` groups (few, such as features) has its
    own quantiles. There are as many buckets as the session has shuffle partitions, more for a larger table (BUCKET_BYTES each)."""
    size = plan_bytes(df)
    if buckets is None and size <= SMALL_BYTES:
        return df
    known = size if size < UNKNOWN_BYTES else 0
    n = buckets or min(MOST_BUCKETS, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // BUCKET_BYTES))
    probes = F.split(F.lit(",".join(str(k / n) for k in range(1, n))), ",").cast("array<double>")  # one literal, however many there are
    cuts = df.groupBy(*parts).agg(F.percentile_approx(value, probes, max(2_000, 10 * n)).alias("_cuts")).withColumn("_coarse", F.filter("_cuts", lambda c, i: (i + 1) % STEP == 0))
    joined = df.join(F.broadcast(cuts), parts) if parts else df.withColumn("_all", F.lit(0)).join(F.broadcast(cuts.withColumn("_all", F.lit(0))), "_all").drop("_all")
    # two short searches instead of a long one: which stretch of STEP cuts, and where in it
    stretch = joined.withColumn("_at", F.size(F.filter("_coarse", lambda c: c < F.col(value))) * STEP)
    within = F.size(F.filter(F.slice("_cuts", F.col("_at") + 1, STEP), lambda c: c < F.col(value)))
    return stretch.withColumn(BUCKET, F.col("_at") + within).drop("_cuts", "_coarse", "_at")


def scan(df: DataFrame, parts: list[str], value: str, descending: bool, out: dict[str, tuple[str, str]]) -> DataFrame:
    """Running aggregates from the first row up to each row in the order of ``value``: out maps a new column to (sum|min|max, column).

    df comes from ``bucketed``; values must be distinct within ``parts``, or ties take their order by chance.
    """
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if BUCKET not in df.columns:
        w = Window.partitionBy(*(parts or [F.lit(0)])).orderBy(way(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*[c for c in df.columns if c not in out], *[_FN[f](c).over(w).alias(o) for o, (f, c) in out.items()])
    totals = df.groupBy(*parts, BUCKET).agg(*[_FN[f](c).alias(f"_t_{o}") for o, (f, c) in out.items()])
    earlier = Window.partitionBy(*(parts or [F.lit(0)])).orderBy(way(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, BUCKET, *[_FN[f](f"_t_{o}").over(earlier).alias(f"_o_{o}") for o, (f, _) in out.items()])
    within = Window.partitionBy(*parts, BUCKET).orderBy(way(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.select("*", *[_FN[f](c).over(within).alias(f"_r_{o}") for o, (f, c) in out.items()])
    joined = run.join(F.broadcast(offsets), [*parts, BUCKET])  # at most MOST_BUCKETS rows a part

    def value_of(o: str, f: str) -> Column:
        a, b = F.col(f"_r_{o}"), F.col(f"_o_{o}")
        return F.when(b.isNull(), a).otherwise(_COMBINE[f](a, b)).alias(o)

    keep = [c for c in df.columns if c not in out]
    return joined.select(*keep, *[value_of(o, f) for o, (f, _) in out.items()])
