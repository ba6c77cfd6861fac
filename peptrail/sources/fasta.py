"""FASTA files: proteins, their peptides, protein groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.functions.peptides import ENZYMES, digest
from peptrail.operators.proteins import ProteinTables, group_proteins


def read_fasta(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(protein, sequence) of every entry; the name ends at the first blank; an entry without sequence has ''."""
    every = [paths] if isinstance(paths, str) else list(paths)
    entries = spark.read.option("lineSep", "\n>").text(every).select(F.regexp_replace("value", r"^\s*>|\r", "").alias("v")).where(F.trim("v") != "")
    head, body = F.substring_index("v", "\n", 1), F.when(F.instr("v", "\n") > 0, F.expr("substring(v, instr(v, '\n') + 1)")).otherwise("")
    return entries.select(F.regexp_extract(head, r"^(\S*)", 1).alias("protein"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def read_proteins(spark: SparkSession, paths: str | Sequence[str], decoy_prefix: str = "decoy_", enzyme: str = ENZYMES["trypsin"], missed_cleavages: int = 2, **options: object) -> ProteinTables:
    """Protein groups and peptide maps of a FASTA file. ValueError if all proteins are decoys."""
    proteins = read_fasta(spark, paths)
    is_decoy = F.col("protein").startswith(decoy_prefix)
    any_target, any_decoy = proteins.agg(F.bool_or(~is_decoy), F.bool_or(is_decoy)).first()
    if not any_target:
        raise ValueError("the FASTA file has no target proteins")
    peptides = digest(proteins, "protein", "sequence", enzyme=enzyme, missed_cleavages=missed_cleavages, **options)
    return group_proteins(peptides, decoy_prefix, bool(any_decoy))
