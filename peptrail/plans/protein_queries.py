"""Queries of protein groups and of the competition of proteins, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.functions import peptides as pep_fn
from peptrail.operators import proteins as prot
from peptrail.plans.core_queries import _BARE, PSM_SQL, WINNERS_SQL, _psm, _t, _winners
from peptrail.plans.packed_sql import SPLIT_SQL


def _split_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(protein, peptide) of the scored records, peptides bare."""
    bare = _psm(spark, sf).withColumn("peptide", pep_fn.bare_peptide(F.col("peptide")))
    return prot.proteins_from_column(bare, "peptide", "proteins")


def _supplied(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as scored peptides of their suppliers: those of odd lines are decoys."""
    target = F.col("l_linenumber") % 2 == 0
    peptide = F.concat(F.col("l_orderkey").cast("string"), F.when(target, "K").otherwise("R"))
    protein = F.concat(F.when(target, "").otherwise("decoy_"), F.col("l_suppkey").cast("string"))
    return _t(spark, sf, "lineitem").select(peptide.alias("peptide"), protein.alias("protein"), target.alias("target"), F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


def protein_groups_unique_shared(spark: SparkSession, sf: str) -> DataFrame:
    """Of every peptide whether it is in one group only, and the first of its groups."""
    t = prot.group_proteins(_supplied(spark, sf).select("protein", "peptide"))
    shared = t.shared.groupBy("peptide").agg(F.min("founder").alias("founder"))
    return t.unique.withColumn("unique_peptide", F.lit(True)).unionByName(shared.withColumn("unique_peptide", F.lit(False))).select("peptide", "unique_peptide", F.col("founder").alias("first_group"))


def protein_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Of every protein those with the same peptides, and the largest that has all its peptides and more."""
    return prot.contained_proteins(_split_pairs(spark, sf))


def protein_subset_grouping(spark: SparkSession, sf: str) -> DataFrame:
    """Peptides in exactly one protein group, with its name."""
    return prot.group_proteins(_split_pairs(spark, sf)).peptide_map


def picked_protein(spark: SparkSession, sf: str) -> DataFrame:
    """The better of each pair of target and decoy supplier, by their unique peptides."""
    rows = _supplied(spark, sf)
    return prot.picked_proteins(rows.drop("protein"), prot.group_proteins(rows.select("protein", "peptide")), "peptide", "score", "target", "id", check=False)


def picked_protein_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Proteins of the records themselves: groups from packed names, competition of target and decoy groups."""
    bare = pep_fn.strip_peptides(_winners(spark, sf), "peptide").withColumn("peptide", F.col("stripped_sequence")).drop("stripped_sequence")
    return prot.picked_proteins(bare, prot.group_proteins(prot.proteins_from_column(bare, "peptide", "proteins")), "peptide", "score", "target", "row_id", check=False)


QUERIES = {f.__name__: f for f in (protein_groups_unique_shared, protein_containment, protein_subset_grouping, picked_protein, picked_protein_groups)}

# contained(a, b): b has all peptides of a and more; twins(protein, twin, n): the first protein with the same peptides.
_SETS = """n AS (SELECT protein, count(*) AS n, list(peptide ORDER BY peptide) AS p FROM m GROUP BY 1),
    twins AS (SELECT protein, n, min(protein) OVER (PARTITION BY p) AS twin FROM n), r AS (SELECT m.* FROM m JOIN twins USING (protein) WHERE protein = twin),
    both_have AS (SELECT x.protein AS a, y.protein AS b, count(*) AS k FROM r x JOIN r y USING (peptide) WHERE x.protein <> y.protein GROUP BY 1, 2),
    contained AS (SELECT a, b, z.n AS m FROM both_have JOIN n x ON x.protein = a JOIN n z ON z.protein = b WHERE k = x.n AND z.n > x.n)"""
_GROUPS = f"""{_SETS}, founders AS (SELECT protein AS founder FROM twins WHERE protein = twin AND protein NOT IN (SELECT a FROM contained)),
    members AS (SELECT founder, protein, n FROM twins JOIN (SELECT a AS twin, b AS founder FROM contained WHERE b IN (SELECT founder FROM founders) UNION ALL SELECT founder, founder FROM founders) USING (twin)),
    names AS (SELECT founder, string_agg(protein, ', ' ORDER BY n DESC, protein) AS protein_group FROM members GROUP BY 1),
    per AS (SELECT peptide, count(*) AS groups, min(protein) AS founder FROM m WHERE protein IN (SELECT founder FROM founders) GROUP BY 1)"""
_PICKED = f"""{_GROUPS}, u AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY seq, target ORDER BY score DESC, id) AS rk FROM x) WHERE rk = 1),
    k AS (SELECT u.*, founder, protein_group, regexp_replace(founder, '^decoy_', '') AS pair FROM u JOIN per ON seq = per.peptide AND groups = 1 JOIN names USING (founder))
    SELECT protein_group, shown AS best_peptide, seq AS stripped_sequence, score, target FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY score DESC, target ASC, id) AS rn FROM k) WHERE rn = 1"""
_SUPPLIED = """l AS (SELECT l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN 'K' ELSE 'R' END AS peptide, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'decoy_' END || l_suppkey AS protein, l_linenumber % 2 = 0 AS target,
    l_extendedprice AS score, l_orderkey * 10 + l_linenumber AS id FROM lineitem), m AS (SELECT DISTINCT protein, peptide FROM l)"""
_PAIRS = f"{SPLIT_SQL}, m AS (SELECT DISTINCT protein, trim({_BARE}, '-') AS peptide FROM p1 JOIN ({PSM_SQL}) USING (row_id))"
_STRIPPED = f"""{SPLIT_SQL}, y AS (SELECT *, trim({_BARE}, '-') AS bare FROM ({WINNERS_SQL})), low AS (SELECT bool_and(bare = lower(bare)) AS low FROM y),
    x0 AS (SELECT row_id, CASE WHEN low THEN upper(bare) ELSE regexp_replace(bare, '[a-z]', '', 'g') END AS seq, target, score FROM y, low),
    again AS (SELECT bool_and(seq = lower(seq)) AS low FROM x0), x AS (SELECT row_id AS id, seq, seq AS shown, target, score FROM x0), m AS (SELECT DISTINCT protein, seq AS peptide FROM p1 JOIN x0 USING (row_id))"""

ORACLES = {
    "protein_groups_unique_shared": f"WITH {_SUPPLIED}, {_GROUPS} SELECT peptide, groups = 1 AS unique_peptide, founder AS first_group FROM per",
    "protein_containment": f"""WITH {_PAIRS}, {_SETS}, best AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY m DESC, b) AS rn FROM contained) WHERE rn = 1)
        SELECT protein, n::BIGINT AS n_peptides, twin, b AS parent FROM twins LEFT JOIN best ON a = twin""",
    "protein_subset_grouping": f"WITH {_PAIRS}, {_GROUPS} SELECT peptide, protein_group FROM per JOIN names USING (founder) WHERE groups = 1",
    "picked_protein": f"WITH {_SUPPLIED}, x AS (SELECT peptide AS seq, peptide AS shown, target, score, id FROM l), {_PICKED}",
    "picked_protein_groups": f"WITH {_STRIPPED}, {_PICKED}",
}
