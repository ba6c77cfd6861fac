"""PepXML files of search results: one row per search hit, with features for re-scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.functions.search_features import any_target, auto_log, insert_modifications, log_candidates, mz_error, one_hot, with_open_modifications

# Scores by which another tool has re-scored the hits already.
RESCORED = ("Percolator q-Value", "Percolator PEP", "Percolator SVMScore")
_SCHEMA = """
    _base_name string, _raw_data string,
    spectrum_query array<struct<_spectrum:string,_end_scan:long,_assumed_charge:int,_retention_time_sec:double,_precursor_neutral_mass:double,
      search_result:array<struct<search_hit:array<struct<_peptide:string,_protein:string,_calc_neutral_pep_mass:double,_num_matched_ions:int,
        _tot_num_ions:int,_num_missed_cleavages:int,_num_tol_term:int,_num_matched_peptides:long,
        alternative_protein:array<struct<_protein:string>>,
        modification_info:struct<mod_aminoacid_mass:array<struct<_position:int,_mass:string>>>,
        search_score:array<struct<_name:string,_value:string>>>>>>>>"""


def hits(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(ms_data_file, scan, charge, ret_time, expmass, calcmass, peptide, proteins, missed_cleavages, ntt, n_candidates, scores) of all hits.

    Ill-formed files are an error. Proteins are the hit's and its alternatives, without flags behind the first blank.
    """
    every = [paths] if isinstance(paths, str) else list(paths)
    runs = spark.read.format("xml").option("rowTag", "msms_run_summary").option("mode", "FAILFAST").schema(_SCHEMA).load(",".join(every))
    run = F.concat(F.coalesce("_base_name", F.lit("")), F.coalesce("_raw_data", F.lit("")))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    pairs = F.transform(
        "spectrum_query", lambda q: F.transform(F.flatten(some(F.transform(q["search_result"], lambda r: r["search_hit"]))), lambda h: F.struct(q.dropFields("search_result").alias("q"), h.alias("h")))
    )
    h = runs.select(run.alias("ms_data_file"), F.inline(F.flatten(some(pairs))))
    mods = F.transform(F.coalesce("h.modification_info.mod_aminoacid_mass", F.expr("array()").cast("array<struct<_position:int,_mass:string>>")), lambda m: F.struct(m["_position"].alias("position"), m["_mass"].alias("mass")))
    first_word = lambda p: F.substring_index(p, " ", 1)
    others = F.transform(F.coalesce("h.alternative_protein", F.expr("array()").cast("array<struct<_protein:string>>")), lambda a: first_word(a["_protein"]))
    scores = F.map_from_entries(F.transform(F.coalesce("h.search_score", F.expr("array()").cast("array<struct<_name:string,_value:string>>")), lambda s: F.struct(s["_name"], s["_value"])))
    return h.select(
        "ms_data_file", F.col("q._end_scan").alias("scan"), F.col("q._assumed_charge").alias("charge"), F.col("q._retention_time_sec").alias("ret_time"),
        F.col("q._precursor_neutral_mass").alias("expmass"), F.col("h._calc_neutral_pep_mass").alias("calcmass"),
        insert_modifications(F.col("h._peptide"), mods).alias("peptide"), F.concat(F.array(first_word(F.col("h._protein"))), others).alias("protein_list"),
        F.col("h._num_missed_cleavages").alias("missed_cleavages"), F.col("h._num_tol_term").alias("ntt"), F.col("h._num_matched_peptides").alias("n_candidates"),
        F.length("h._peptide").alias("peptide_length"), scores.alias("scores"),
    )


def read_pepxml(spark: SparkSession, paths: str | Sequence[str], decoy_prefix: str = "decoy_", exclude_features: Sequence[str] = (), open_modification_bin_size: float | None = None, most_scores: int = 1_000) -> DataFrame:
    """One row per hit with label, spectrum columns, peptide, proteins (tab-joined) and features.

    Features: every search score, mass differences, missed cleavages, tolerable termini, log of candidates, charge one-hot; wide-ranging
    ones as logarithms. A hit is a target if any of its proteins lacks the prefix. Hits that were re-scored already are an error.
    """
    found = hits(spark, paths)
    names = sorted(r[0] for r in found.select(F.explode(F.map_keys("scores"))).distinct().limit(most_scores + 1).collect())
    if len(names) > most_scores:
        raise ValueError(f"the hits have more than {most_scores} kinds of scores")
    if any(n in RESCORED for n in names):
        raise ValueError("these hits have been re-scored already")
    df = found.select(
        "ms_data_file", "scan", "ret_time", "charge", "expmass", "calcmass", "peptide", F.array_join("protein_list", "\t").alias("proteins"), any_target(F.col("protein_list"), decoy_prefix).alias("label"),
        "missed_cleavages", "ntt", "peptide_length", (F.col("expmass") - F.col("calcmass")).alias("mass_diff"), mz_error(F.col("expmass"), F.col("calcmass"), F.col("charge")).alias("abs_mz_diff"), log_candidates(F.col("n_candidates")).alias("num_matched_peptides"),
        *[F.col("scores")[n].alias(n) for n in names],
    )
    if open_modification_bin_size:
        df = with_open_modifications(df, "peptide", "mass_diff", open_modification_bin_size)
    df = auto_log(df, [n for n in names if n not in exclude_features])
    return one_hot(df, "charge", "charge_").drop(*exclude_features)
