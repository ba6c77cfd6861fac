"""An equi-join that no hot key can hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the large side that one salted share of a key should hold.
SHARE_ROWS = 200_000
#: At most so many keys are salted; each key beyond them holds less than 1/1000 of the rows.
MOST_HOT = 1_000


#: Rows and bytes up to which the small side of a join is sent to all tasks.
FEW_ROWS, FEW_BYTES = 200_000, 16 << 20


def join_skewed(big: DataFrame, small: DataFrame, key: str | list[str], spread: str, how: str = "left", share_rows: int | None = None) -> DataFrame:
    """big joined with small on ``key`` (one or more columns); the rows of a hot key are spread by a hash of the column ``spread``.

    Hot keys are the MOST_HOT largest among those with more than ``share_rows`` rows, so their broadcast list has a fixed bound. Each of
    their rows gets one of ``ceil(n / share_rows)`` salts, and small's rows of that key are repeated once a salt. Spark may still turn the
    join into a broadcast join where small proves small. Null keys match nothing.
    """
    share_rows = SHARE_ROWS if share_rows is None else share_rows
    keys = [key] if isinstance(key, str) else key
    hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share_rows).orderBy(F.desc("_n"), *keys).limit(MOST_HOT)
    hot = F.broadcast(hot.select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)], F.ceil(F.col("_n") / share_rows).cast("int").alias("_salts")))
    names = [f"_hot{i}" for i in range(len(keys))]

    def marked(df: DataFrame) -> DataFrame:
        same = [F.col(k) == F.col(n) for k, n in zip(keys, names)]
        return df.join(hot, same, "left").drop(*names)

    left = marked(big).withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = marked(small)
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def join_checked(big: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "left") -> DataFrame:
    """As join_skewed; small, which is made already (see cut_lineage), is counted, and sent to all tasks if it is within FEW_ROWS and FEW_BYTES
    of text. The result is the same either way."""
    n, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if n <= FEW_ROWS and size <= FEW_BYTES:
        return big.join(F.broadcast(small), keys, how)
    return join_skewed(big, small, keys, spread, how)
