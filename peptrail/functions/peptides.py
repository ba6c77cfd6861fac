"""Functions on peptide and protein strings, all in the JVM but for digests by an arbitrary pattern."""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cleavage rules of common enzymes; a site is where a match ends.
ENZYMES = {
    "trypsin": "[KR](?!P)", "trypsin/p": "[KR]", "lysc": "[K](?!P)", "lysc/p": "K", "argc": "R(?!P)", "aspn": ".(?=D)", "gluc": "[DE](?!P)",
    "chymotrypsin": "[FWYL](?!P)", "cnbr": "M", "pepsin": "[FL](?!P)",
}


def bare_peptide(c: Column) -> Column:
    """A peptide without modifications in brackets, flanking residues and terminal dashes; case as written."""
    no_mods = F.regexp_replace(F.regexp_replace(c, r"\[.*?\]", ""), r"\(.*?\)", "")
    core = F.regexp_replace(F.regexp_replace(no_mods, r"^.*?\.", ""), r"\..*?$", "")
    return F.btrim(core, F.lit("-"))


def strip_peptides(df: DataFrame, peptide: str, out: str = "stripped_sequence") -> DataFrame:
    """df with bare sequences: if all of the column are lower case they are raised, else lower-case letters (modifications) are dropped.

    Null stays null. The case of the whole column is one aggregate of one row.
    """
    bare = df.withColumn(out, bare_peptide(F.col(peptide)))
    low = bare.agg(F.bool_and(F.col(out) == F.lower(out)).alias("_low")).withColumn("_all", F.lit(0))
    joined = bare.withColumn("_all", F.lit(0)).join(F.broadcast(low), "_all")
    return joined.withColumn(out, F.when(F.col("_low"), F.upper(out)).otherwise(F.regexp_replace(out, "[a-z]", ""))).drop("_low", "_all")


def base_sequence(c: Column) -> Column:
    """A sequence without bracketed modifications and flanking residues."""
    no_mods = F.regexp_replace(F.regexp_replace(c, r"\[.*?\]", ""), r"\(.*?\)", "")
    return F.regexp_replace(F.regexp_replace(no_mods, r"^.*?\.", ""), r"\..*?$", "")


def composition_key(c: Column) -> Column:
    """Residues in alphabetical order: equal for permutations of each other."""
    return F.array_join(F.array_sort(F.split(c, "")), "")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def cleavage_sites(sequence: str, enzyme: str) -> list[int]:
    """0, the ends of all matches of the pattern, and the sequence's length."""
    inner = {m.end() for m in re.finditer(enzyme, sequence)}
    return sorted({0, len(sequence)} | inner)


def digest_sequence(sequence: str, enzyme: str = ENZYMES["trypsin"], missed_cleavages: int = 0, clip_nterm_methionine: bool = False, min_length: int = 6, max_length: int = 50, semi: bool = False) -> set[str]:
    """The peptides between cleavage sites, with up to so many sites missed.

    ``clip_nterm_methionine``: also without a leading M; ``semi``: also the peptides that have only one end at a site.
    """
    sites, found = cleavage_sites(sequence, enzyme), set()

    def keep(p: str) -> None:
        if min_length <= len(p) <= max_length:
            found.add(p)

    for i in range(len(sites) - 1):
        for j in range(i + 1, min(i + missed_cleavages + 2, len(sites))):
            whole = sequence[sites[i] : sites[j]]
            variants = [whole] + ([whole[1:]] if clip_nterm_methionine and i == 0 and whole.startswith("M") else [])
            for p in variants:
                keep(p)
                if semi:
                    for k in range(1, len(p)):
                        keep(p[k:])
                        keep(p[:k])
    return found


def digest(df: DataFrame, key: str, sequence: str, out: str = "peptide", **options: object) -> DataFrame:
    """(key, out): the distinct peptides of each sequence; null and empty sequences give none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def peptides(s: pd.Series) -> pd.Series:
        return pd.Series([sorted(digest_sequence(x, **options)) if x else [] for x in s], dtype=object)

    return df.select(F.col(key), F.explode(peptides(F.col(sequence))).alias(out))


def digest_sql(df: DataFrame, key: str, sequence: str, missed_cleavages: int = 0, min_length: int = 6, max_length: int = 50, out: str = "peptide") -> DataFrame:
    """As ``digest`` for a cut behind every K and R, without leaving the JVM."""
    pieces = F.filter(F.split(F.col(sequence), "(?<=[KR])"), lambda p: p != "")
    windows = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("_p")),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(missed_cleavages + 1), F.size("_p") - i + 1)), lambda n: F.array_join(F.slice("_p", i, n), "")),
        )
    )
    each = df.where(F.length(sequence) > 0).select(F.col(key), pieces.alias("_p")).where(F.size("_p") > 0).select(F.col(key), F.explode(F.array_distinct(windows)).alias(out))
    return each.where(F.length(out).between(min_length, max_length))


def permutation(length: int, seed: int = 1) -> list[int]:
    """One shared permutation of places for each length; it moves something if it can."""
    places = list(range(length))
    for attempt in range(10):
        random.Random(f"{seed}-{length}-{attempt}").shuffle(places)
        if length < 2 or places != list(range(length)):
            break
    return places


def decoy_sequence(sequence: str, enzyme: str = ENZYMES["trypsin"], reverse: bool = False, seed: int = 1) -> str:
    """A decoy: the inside of each enzymatic peptide reversed or permuted; first and last residues stay, so it is cut alike."""
    sites, out = cleavage_sites(sequence, enzyme), []
    for a, b in zip(sites, sites[1:]):
        p = sequence[a:b]
        inner = p[1:-1]
        inner = inner[::-1] if reverse else "".join(inner[k] for k in permutation(len(inner), seed))
        out.append(p[:1] + inner + p[-1:] if len(p) > 1 else p)
    return "".join(out)


def decoys(df: DataFrame, name: str, sequence: str, prefix: str = "decoy_", enzyme: str = ENZYMES["trypsin"], reverse: bool = False, seed: int = 1) -> DataFrame:
    """(name, sequence) of a decoy for each protein; null sequences stay null."""

    @F.pandas_udf(T.StringType())
    def make(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decoy_sequence(x, enzyme, reverse, seed))

    return df.select(F.concat(F.lit(prefix), F.col(name)).alias(name), make(F.col(sequence)).alias(sequence))
