"""Confidence from histograms: two bounded passes over data of any size, or a stream that keeps the histogram as its state.

Pass 1 takes the range and spread of the scores, pass 2 the target-decoy histogram (at most 500 bins); q-values and error probabilities
are then lookups, a map over the rows without any shuffle of them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from peptrail.operators.histogram import Histogram, bin_of, histogram, interpolate
from peptrail.operators.peps import curve_hist
from peptrail.operators.qvalues import as_target, curve_from_histogram
from peptrail.session import shared_folder

BINS = (50, 500)


def lookup(df: DataFrame, h: Histogram, score: str) -> DataFrame:
    """df with q_value and pep from a histogram."""
    x = F.col(score).cast("double")
    out = df.withColumn("q_value", interpolate(x, h.lo, h.width, curve_from_histogram(h)))
    return out.withColumn("pep", interpolate(x, h.lo + h.width / 2, h.width, curve_hist(h)))


def histogram_confidence(df: DataFrame, score: str, target: str, rule: str = "scott", clip: tuple[int, int] = BINS) -> DataFrame:
    """df with q_value and pep within a bin's width of the exact ones. Nulls get null; an empty table stays empty."""
    h = histogram(df, score, target, rule, clip)
    if h is None:
        return df.withColumn("q_value", F.lit(None).cast("double")).withColumn("pep", F.lit(None).cast("double"))
    return lookup(df, h, score)


def stream_histogram(stream: DataFrame, score: str, target: str, lo: float, hi: float, bins: int = 500) -> DataFrame:
    """A streaming aggregate (bin, targets, decoys): its state is one row a bin, however long the stream. Scores beyond the ends count in
    the end bins."""
    y = as_target(F.col(target), stream.schema[target].dataType.simpleString())
    x = F.least(F.greatest(F.col(score).cast("double"), F.lit(lo)), F.lit(hi))
    return stream.select(bin_of(x, lo, hi, bins).alias("bin"), y.alias("_y")).where("bin is not null and _y is not null").groupBy("bin").agg(F.count_if(F.col("_y")).alias("targets"), F.count_if(~F.col("_y")).alias("decoys"))


def start_stream(stream: DataFrame, score: str, target: str, lo: float, hi: float, on_update: Callable[[Histogram, int], None], checkpoint: str, bins: int = 500, once: bool = True) -> StreamingQuery:
    """Runs the histogram over a stream and hands each new state to ``on_update``, which may rate rows with ``lookup``."""

    def batch(df: DataFrame, number: int) -> None:
        t, d = [0] * bins, [0] * bins
        for r in df.collect():
            t[r["bin"]], d[r["bin"]] = r["targets"], r["decoys"]
        on_update(Histogram(lo, hi, t, d), number)

    writer = stream_histogram(stream, score, target, lo, hi, bins).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_scores(stream: DataFrame, time: str, score: str, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """(window, n, best, mean) of an event stream; events later than ``lateness`` are dropped and their windows' state freed."""
    w = stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("window"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("best"), F.avg(score).alias("mean"))


def stream_events(spark: SparkSession, path: str, lo: float = 0.0, hi: float = 1_000.0, bins: int = 100) -> DataFrame:
    """(bin, targets, decoys) of an events table read as a stream up to its present end: purchases are targets."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path)
    parts = os.path.isdir(path)
    stream = spark.readStream.schema(schema).parquet(path if parts else os.path.join(folder, name[:-1] + "[" + name[-1] + "]"))
    y = stream.where("event_type is not null").select("value", (F.col("event_type") == "purchase").alias("target"))
    last: list[list[tuple]] = []

    def batch(df: DataFrame, _: int) -> None:
        last[:] = [[tuple(r) for r in df.select("bin", "targets", "decoys").collect()]]  # at most one row a bin

    state = stream_histogram(y, "value", "target", lo, hi, bins)
    where = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    state.writeStream.outputMode("complete").option("checkpointLocation", where).foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    return spark.createDataFrame(last[0] if last else [], "bin int, targets long, decoys long")
