"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight, which is its share of all tokens, and a schedule, which spreads them over training time: its cumulative demand is
the integral of the schedule, scaled to its share. The inverse of that integral assigns a training position to each token of the source,
and so to each use of a document; the mixture is the uses, range-sorted by position. Cumulative tokens of a source are prefix sums in two
phases over hash buckets, so a source that holds most rows is spread like any other.

What a demand lacks where the next document is too long for it is filled with later ones that fit, round by round: what is missing at
least halves with each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peptrail.llm.tokens import TOKENIZER, same_source, sized_documents
from peptrail.session import cut_lineage

#: Steps of the grid on which schedules are integrated.
GRID = 1_024
#: Sources that mix_targets may have.
MOST_SOURCES = 10_000
#: Tokens' rows that a bucket of the prefix sum holds on average.
BUCKET_ROWS = 50_000

#: Points of all sources' curves, which go to every task.
MOST_CORNERS = 1_000_000

Schedule = Sequence[tuple[float, float]]
CONSTANT: Schedule = ((0.0, 1.0),)


def demand(weights: Mapping[str, float], available: Mapping[str, int], repeats: Mapping[str, int], total: float, schedules: Mapping[str, Schedule] | None = None) -> dict[str, np.ndarray]:
    """Cumulative token demand of each source at GRID + 1 equidistant times.

    Weights are shares of their sum over the sources that have tokens. A source whose demand exceeds its tokens times its repeats gives
    all that; what it lacks is taken from the others by their weights, as long as they have any. A schedule is (time, rate) points, linear
    between them; it says when a source's tokens come, not how many. One that is nowhere positive counts as constant.
    """
    times = np.linspace(0.0, 1.0, GRID + 1)
    live = [s for s in sorted(weights) if weights[s] > 0 and available.get(s, 0) > 0 and repeats.get(s, 0) > 0]
    if not live:
        return {}
    share = np.array([weights[s] for s in live])
    limit = np.array([float(available[s]) * repeats[s] for s in live])
    amount, open_ = np.zeros(len(live)), np.ones(len(live), bool)
    left = min(float(total), limit.sum())
    while open_.any():
        want = left * share / share[open_].sum()
        over = open_ & (want >= limit)
        if not over.any():
            amount[open_] = want[open_]
            break
        amount[over] = limit[over]
        left -= limit[over].sum()
        open_ &= ~over
    out = {}
    for s, n in zip(live, amount):
        rate = np.maximum(np.interp(times, *zip(*sorted((schedules or {}).get(s, CONSTANT)))), 0)
        area = np.concatenate([[0.0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        out[s] = n * (area / area[-1] if area[-1] > 0 else times)
    return out


def _corners(curve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, times) of a cumulative curve without the points that lie on a line between their neighbours."""
    step = np.diff(curve)
    keep = np.concatenate([[True], np.abs(np.diff(step)) > 1e-9 * max(1.0, float(curve[-1])), [True]])
    return curve[keep], np.linspace(0.0, 1.0, len(curve))[keep]


def _running(df: DataFrame, buckets: int) -> DataFrame:
    """df (source, n_tokens, h, row) with ``end``: the tokens of its source up to and with this row, in the order of h."""
    placed = df.withColumn("bucket", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * buckets).cast("int"))
    per = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("b"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("source", "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = placed.withColumn("end", F.sum("n_tokens").over(within)).join(offsets, ["source", "bucket"])
    return ends.withColumn("end", F.col("end") + F.col("offset")).drop("bucket", "offset")


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, schedules: Mapping[str, Schedule] | None = None, seed: int = 1, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(uses, shares). uses: position (0 to 1), doc_id, copy (from 1), source, n_tokens, sorted by position; shares: one row per target.

    shares: source, target_share, actual_share, available_tokens, used_tokens, max_copies, max_repeats. docs: doc_id, text, source; targets:
    source, weight, max_repeats. Spellings of a source count as one (the largest weight and repeats, if a target is given twice). The size
    of the mixture is ``total_tokens``, by default the tokens of all documents of the wanted sources. A use that would end more than half
    over the demand is left out, and later documents of the source that fit take its place. Documents of other or no sources, and those without tokens, don't take part; equal documents and repeated
    rows are documents each. Without any usable target both results are empty but for the targets' rows.
    """
    spark = docs.sparkSession
    goal = targets.select(same_source(F.col("source")).alias("source"), "weight", "max_repeats").where("source is not null").groupBy("source").agg(F.max("weight").alias("w"), F.max("max_repeats").alias("r"))
    rows = goal.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    weights = {r[0]: float(r[1] or 0) for r in rows}
    repeats = {r[0]: int(r[2] or 0) for r in rows}
    known = sized_documents(docs, tokenizer).where(F.col("source").isin(*weights)) if weights else sized_documents(docs, tokenizer).where(F.lit(False))
    # the row number, fixed by the checkpoint, tells repeated documents apart
    sized = cut_lineage(known.select("source", "doc_id", "n_tokens", F.monotonically_increasing_id().alias("row"))).withColumn("h", F.xxhash64("doc_id", "row", F.lit(seed)))
    sums = {r[0]: (int(r[1]), int(r[2])) for r in sized.groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}
    available = {s: v[0] for s, v in sums.items()}
    total = float(sum(available.values()) if total_tokens is None else total_tokens)
    curves = demand(weights, available, repeats, total, schedules)
    buckets = max(1, -(-max([v[1] for v in sums.values()], default=1) // BUCKET_ROWS))

    facts = [(s, float(c[-1]), available[s], repeats[s]) for s, c in curves.items()]
    fact = F.broadcast(spark.createDataFrame(facts, "source string, amount double, available long, repeats int"))  # at most MOST_SOURCES rows
    middle = F.col("end") - F.col("n_tokens") / 2
    copies = F.least(F.col("repeats").cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("amount") - middle) / F.col("available")) + 1))
    placed = cut_lineage(_running(sized, buckets).join(fact, "source").withColumn("copies", copies))
    some = placed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    begin = F.col("end") - F.col("n_tokens") + (F.col("copy") - 1) * F.col("available")
    uses = some.select("source", "doc_id", "n_tokens", begin.cast("double").alias("token"), "copy")

    # what a source still wants, and the documents that have had one use less than those before them
    used = {r[0]: int(r[1]) for r in placed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies"))).collect()}
    lacks = {s: float(c[-1]) - used.get(s, 0) for s, c in curves.items()}
    least = F.floor(F.col("amount") / F.col("available"))
    spare = placed.where((F.col("copies") <= least) & (F.col("copies") < F.col("repeats"))).select("source", "doc_id", "n_tokens", "row", "h", (F.col("copies") + 1).alias("copy"))
    while any(v >= 1 for v in lacks.values()):
        gap = F.broadcast(spark.createDataFrame([(s, v, float(curves[s][-1])) for s, v in lacks.items() if v >= 1], "source string, gap double, amount double"))
        fits = _running(spare.join(gap, "source").where("n_tokens <= gap"), buckets)
        # a use that ends over the demand, by half of it at most, still counts
        more = cut_lineage(fits.where(F.col("end") - F.col("n_tokens") / 2 <= F.col("gap")))
        got = {r[0]: int(r[1]) for r in more.groupBy("source").agg(F.sum("n_tokens")).collect()}
        if not got:
            break
        uses = uses.unionByName(more.select("source", "doc_id", "n_tokens", (F.col("amount") - F.col("gap") + F.col("end") - F.col("n_tokens")).alias("token"), "copy"))
        spare = spare.join(more.select("row"), "row", "left_anti")
        lacks = {s: v - got.get(s, 0) for s, v in lacks.items() if s in got}

    corners = {s: _corners(c) for s, c in curves.items()}
    if (size := sum(len(x) for x, _ in corners.values())) > MOST_CORNERS:
        raise ValueError(f"the schedules have {size} points, more than {MOST_CORNERS}")

    @F.pandas_udf(T.DoubleType())
    def invert(source: pd.Series, token: pd.Series) -> pd.Series:
        out = np.zeros(len(source))
        for s in source.unique():
            at = (source == s).to_numpy()
            out[at] = np.interp(token[at], *corners[s])
        return pd.Series(out)

    uses = uses.withColumn("position", invert("source", "token"))
    uses = uses.select("position", "doc_id", F.col("copy").cast("int"), "source", "n_tokens")

    totals = uses.groupBy("source").agg(F.sum("n_tokens").alias("used"), F.max("copy").alias("max_copies"))
    live = sum(w for s, w in weights.items() if w > 0 and available.get(s, 0) > 0)
    targets_df = spark.createDataFrame([(s, weights[s] / live if live and available.get(s, 0) > 0 else 0.0, available.get(s, 0), repeats[s]) for s in sorted(weights)], "source string, target_share double, available_tokens long, max_repeats int")
    all_used = F.sum(F.coalesce("used", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    joined = targets_df.join(totals, "source", "left")
    shares = joined.select(
        "source", "target_share", F.coalesce(F.try_divide(F.col("used"), all_used), F.lit(0.0)).alias("actual_share"), "available_tokens",
        F.coalesce("used", F.lit(0)).alias("used_tokens"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"), "max_repeats",
    )
    return uses.orderBy("position", "source", "doc_id", "copy"), shares
