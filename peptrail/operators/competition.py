"""Best row per group: competition within a spectrum, rollup to levels, folds and samples.

A best row is taken by ``max_by`` over an order key, which aggregates before the shuffle: however many rows a key holds, each task sends
one. Several levels share one shuffle: the winners are exploded to (level, key) and compete there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which levels can be computed from which, from the finest.
LEVEL_PARENTS = {"precursor": ("psm",), "modified_peptide": ("precursor",), "peptide": ("modified_peptide",), "peptide_group": ("precursor",)}


def _rank(score: Column, target: Column | None, ties: list[Column]) -> Column:
    """Orders rows from worst to best: by score; among equals a decoy is better (conservative), then the smaller tie-break."""
    parts = [F.coalesce(score.cast("double"), F.lit(float("-inf"))).alias("s")]
    if target is not None:
        parts.append((~F.coalesce(target, F.lit(False))).cast("int").alias("d"))
    return F.struct(*parts, *[t.alias(f"t{i}") for i, t in enumerate(ties)])


def _negated(df: DataFrame, c: str) -> Column:
    """A tie-break that falls as the column rises; strings are compared by a hash after the numeric ones."""
    kind = df.schema[c].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.coalesce(-F.col(c).cast("double" if kind in ("float", "double") else "bigint"), F.lit(0))
    return F.xxhash64(c)


def best_per_group(df: DataFrame, keys: list[str], score: str, target: str | None = None, tie_break: list[str] | None = None, descending: bool = True) -> DataFrame:
    """For each distinct ``keys`` the one row that scores best.

    Ties: a decoy before a target if ``target`` is named, then the smallest ``tie_break`` (which should be unique). Null keys form a group
    of their own; null scores lose to any other. Extra columns come along. An empty table stays empty.
    """
    score_col = F.col(score) if descending else -F.col(score)
    rank = _rank(score_col, F.col(target) if target else None, [_negated(df, c) for c in tie_break or []])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def best_per_group_random(df: DataFrame, keys: list[str], score: str, row_id: str, seed: int = 1) -> DataFrame:
    """As best_per_group, with ties broken by a seeded hash of the row id: reproducible, and independent of the partitioning."""
    return best_per_group(df.withColumn("_tie", F.xxhash64(F.col(row_id), F.lit(seed))), keys, score, None, ["_tie"]).drop("_tie")


def psm_competition(df: DataFrame, spectrum: list[str], score: str, target: str, row_id: str, deduplication: bool = True) -> DataFrame:
    """The winner of each spectrum; all rows if ``deduplication`` is off."""
    return best_per_group(df, spectrum, score, target, [row_id]) if deduplication else df


def rollup(winners: DataFrame, levels: dict[str, list[str]], score: str, target: str, row_id: str) -> DataFrame:
    """The best row of each entity on each level in one table with a column ``level``; levels maps a name to its key columns.

    Levels are independent of each other, and computed from the winners of the spectra. Rows with a null key don't enter that level.
    """
    rest = winners.columns
    entries = F.array(*[F.struct(F.lit(n).alias("level"), F.array(*[F.col(k).cast("string") for k in keys]).alias("_key")) for n, keys in levels.items()])
    each = winners.select("*", F.inline(entries)).where(~F.exists("_key", lambda k: k.isNull()))
    rank = _rank(F.col(score), F.col(target), [_negated(winners, row_id)])
    best = each.groupBy("level", "_key").agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select("level", "_row.*")


def reachable_levels(base: str) -> list[str]:
    """The levels that can be rolled up from a base level, itself first."""
    out = [base]
    for level, parents in LEVEL_PARENTS.items():
        if any(p in out for p in parents) and level not in out:
            out.append(level)
    return out


def fold_split(df: DataFrame, groups: list[str], folds: int = 3, hash_column: Column | None = None, out: str = "fold") -> DataFrame:
    """df with a fold from 0, near-equal in size, never splitting rows that share ``groups``.

    Groups are ordered by a hash and cut at the cumulative sizes; the running count is a two-phase scan, which gives the hash that each
    fold begins with: rows get their fold by comparing, without a join. Null group values count as a value. The hash is crc32 of the
    values' text unless ``hash_column`` gives another integer.
    """
    from peptrail.operators.prefix import bucketed, scan

    text = F.concat_ws("|", *[F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in groups])
    hashed = df.withColumn("_h", F.crc32(text) if hash_column is None else hash_column)
    per = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    ends = scan(bucketed(per, [], "_h"), [], "_h", False, {"_end": ("sum", "_n")})
    total = per.agg(F.sum("_n").alias("_total")).withColumn("_all", F.lit(0))
    at = ends.withColumn("_all", F.lit(0)).join(F.broadcast(total), "_all").withColumn("_start", F.col("_end") - F.col("_n"))
    size, more = F.floor(F.col("_total") / folds), F.col("_total") % folds
    cut = lambda i: size * i + F.least(more, F.lit(i))
    begins = at.agg(*[F.min(F.when(F.col("_start") >= cut(i), F.col("_h"))).alias(f"_b{i}") for i in range(1, folds)], F.lit(0)).first()
    fold = sum([F.lit(0) if b is None else (F.col("_h") >= F.lit(b)).cast("int") for b in begins[: folds - 1]], F.lit(0))
    return hashed.withColumn(out, fold).drop("_h")


def training_sample(df: DataFrame, parts: list[str], row_id: str, n: int, seed: int = 1) -> DataFrame:
    """At most n rows of each of the ``parts`` (few: folds, files), by a seeded hash of the row id, without replacement.

    The n-th smallest hash of a part bounds its sample; it is found among the rows of each bucket of hashes, so no task sorts a part.
    """
    h = F.xxhash64(F.col(row_id), F.lit(seed))
    spread = df.withColumn("_h", h).withColumn("_b", F.pmod(F.xxhash64(F.col(row_id), F.lit(seed + 1)), F.lit(256)))
    few = spread.withColumn("_r", F.row_number().over(Window.partitionBy(*parts, "_b").orderBy("_h", row_id))).where(F.col("_r") <= n)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(*parts).orderBy("_h", row_id))).where(F.col("_r") <= n).drop("_h", "_b", "_r")


def entity_counts(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """(targets, decoys, rows, entities): how many rows and distinct keys there are."""
    return df.agg(F.count_if(F.col(target)).alias("targets"), F.count_if(~F.col(target)).alias("decoys"), F.count(F.lit(1)).alias("rows"), F.count_distinct(*[F.col(k) for k in keys]).alias("entities"))


def target_decoy_split(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(target)), df.where(~F.col(target))
