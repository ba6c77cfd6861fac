"""Queries of problems 6 to 8: packing, mixing, sentence units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peptrail.llm.mixing import mixture
from peptrail.llm.packing import packed, usage
from peptrail.llm.sentences import sentence_units

#: Sources of raw machine output, which should not share a container.
APART = (("mt_feed", "ocr_backfile"),)


#: Sources that are repeated come late, the machine's own output comes early.
SCHEDULES = {"mt_feed": ((0.0, 2.0), (1.0, 0.0)), "ocr_backfile": ((0.0, 1.5), (1.0, 0.5)), "examiner_notes": ((0.0, 0.2), (1.0, 1.8)), "standards_annex": ((0.0, 0.2), (1.0, 1.8))}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every document in the containers of every capacity."""
    return packed(_t(spark, sf, "documents"), _t(spark, sf, "pack_capacities"), APART)


def p6_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and unused space of every capacity."""
    return usage(p6_packed(spark, sf))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture in training order."""
    return mixture(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"), schedules=SCHEDULES)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares."""
    return mixture(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"), schedules=SCHEDULES)[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_units(_t(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p6_packed, p6_usage, p7_mixture, p7_shares, p8_found)}
ORACLES: dict[str, str] = {}
