"""Every query runs on the smallest tables, and agrees with its SQL where there is some."""

import compare
import duckdb
import pytest
from compare import TABLES, same

from peptrail.plans import core_queries, data_queries, protein_queries

QUERIES = core_queries.QUERIES | protein_queries.QUERIES | data_queries.QUERIES
ORACLES = core_queries.ORACLES | protein_queries.ORACLES | data_queries.ORACLES
SLOW = {"brew_scores", "end_to_end"}

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the tables aren't here")


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == sum(len(m.QUERIES) for m in (core_queries, protein_queries, data_queries))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert same(spark, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("shift", [4_000, -4_000, 9 * 10**12])
def test_fold_split_large_keys(spark, tmp_path, monkeypatch, shift):
    """Run ids whose hash exceeds a bigint before its remainder is taken."""
    duckdb.execute(f"COPY (SELECT * REPLACE (run_id + {shift} AS run_id) FROM '{TABLES}/psms.parquet') TO '{tmp_path}/psms.parquet'")
    monkeypatch.setattr(compare, "TABLES", tmp_path)
    assert same(spark, QUERIES["fold_split"], ORACLES["fold_split"]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(TABLES)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
