"""Queries of problems 1 to 5: packed fields, hot keys, failing rows, nested records, drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.operators.dense_accumulate import accumulate
from peptrail.operators.nested_records import flatten_children, linked_tables
from peptrail.operators.packed_values import split_packed
from peptrail.operators.reject_rows import load_lines
from peptrail.operators.schema_drift import changes, unify
from peptrail.plans.packed_sql import SPLIT_SQL


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_packed(_t(spark, sf, "psms"), "proteins", ["row_id"], value="protein")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return accumulate(_t(spark, sf, "psms"), "peptide", "refactoredxcorr", "row_id").select("peptide", "row_id")


def p2_peptide_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Of every peptide the number of scored rows and the best score."""
    return accumulate(_t(spark, sf, "psms"), "peptide", "refactoredxcorr", "row_id").select("peptide", F.col("n").alias("n_rows"), "best_score")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return load_lines(_t(spark, sf, "pin_lines"), _t(spark, sf, "pin_files"))[1]


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The valid lines, one value per header column."""
    return load_lines(_t(spark, sf, "pin_lines"), _t(spark, sf, "pin_files"))[0].select("line_id", "file_id", "values")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return flatten_children(_t(spark, sf, "pepxml_queries"), "query_id", "query_xml")


def p4_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The table of hits with all their attributes."""
    return linked_tables(_t(spark, sf, "pepxml_queries"), "query_id", "query_xml")["hit"].withColumn("attributes", F.to_json("attributes"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return changes(_t(spark, sf, "pin_lines"), _t(spark, sf, "pin_files")).select("file_id", "field_name", "change_kind")


def p5_unified(spark: SparkSession, sf: str) -> DataFrame:
    """All valid lines of all files in one consistent table."""
    return unify(_t(spark, sf, "pin_lines"), _t(spark, sf, "pin_files"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_peptide_totals, p3_found, p3_clean, p4_found, p4_hits, p5_found, p5_unified)}

ORACLES = {
    "p1_found": f"WITH {SPLIT_SQL} SELECT row_id, pos, protein FROM p1",
    "p2_found": """
        SELECT peptide, row_id FROM (
          SELECT peptide, row_id, row_number() OVER (PARTITION BY peptide ORDER BY refactoredxcorr DESC, row_id) AS rn
          FROM psms WHERE peptide IS NOT NULL AND refactoredxcorr IS NOT NULL AND NOT isnan(refactoredxcorr))
        WHERE rn = 1""",
    "p2_peptide_totals": """
        SELECT peptide, count(*)::BIGINT AS n_rows, max(refactoredxcorr) AS best_score FROM psms
        WHERE peptide IS NOT NULL AND refactoredxcorr IS NOT NULL AND NOT isnan(refactoredxcorr) GROUP BY peptide""",
}
