"""Protein groups and picked-protein competition."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.functions.peptides import composition_key, strip_peptides
from peptrail.operators.competition import best_per_group
from peptrail.operators.packed_values import split_packed
from peptrail.operators.skew import join_skewed
from peptrail.session import cut_lineage

log = logging.getLogger(__name__)



@dataclass(frozen=True)
class ProteinTables:
    """unique: (peptide, founder) of peptides in exactly one group; shared: (peptide, founder) of the others, a row for each of their groups;
    members: (founder, protein, n), n the member's peptides; pairs: (target, decoy) proteins.

    A group is known by its founder, the first of its members. Its name, all members' names strung together, is made only for output.
    """

    unique: DataFrame
    shared: DataFrame
    members: DataFrame
    pairs: DataFrame
    decoy_prefix: str
    has_decoys: bool

    @property
    def names(self) -> DataFrame:
        """(founder, protein_group, decoy_group): each group's name, and the one that its decoys would have. Members come by falling number of
        peptides, then by name. A row is as long as the name is."""
        order = F.struct((-F.col("n")).alias("n"), "protein")
        of = F.array_sort(F.collect_list(order))["protein"]
        named = self.members.groupBy("founder").agg(of.alias("of"))
        prefixed = F.transform("of", lambda p: F.concat(F.lit(self.decoy_prefix), p))
        return named.select("founder", F.array_join("of", ", ").alias("protein_group"), F.array_join(prefixed, ", ").alias("decoy_group"))

    @property
    def peptide_map(self) -> DataFrame:
        """(peptide, protein_group) of peptides in exactly one group."""
        return self.unique.join(self.names, "founder").select("peptide", "protein_group")


def equal_sets(peptides: DataFrame) -> DataFrame:
    """(protein, twin, n): the first protein, by name, that has exactly the same peptides, and their number.

    Sets are compared by their size and two sums of 64-bit hashes, so members of a large class of equal proteins never meet in pairs.
    """
    h = lambda seed: F.sum(F.xxhash64("peptide", F.lit(seed)).cast("decimal(38,0)"))
    prints = peptides.distinct().groupBy("protein").agg(F.count(F.lit(1)).alias("n"), h(1).alias("h1"), h(2).alias("h2"))
    first = prints.groupBy("n", "h1", "h2").agg(F.min("protein").alias("twin"))
    return prints.join(first, ["n", "h1", "h2"]).select("protein", "twin", "n")


def parents_of_sets(peptides: DataFrame, twins: DataFrame) -> DataFrame:
    """(protein, parent): among proteins of different sets, those whose peptides are all peptides of a larger one.

    Only proteins that have a protein's rarest peptide can be its parents. The holders of a hot peptide are spread over tasks, and a bitmap
    of 128 hashed peptides a protein drops nearly all that can't be parents where they meet; the peptides of those left are counted.
    """
    bit = lambda seed: F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(peptide, {seed}), 64) as int))"))
    sets = peptides.select("protein", "peptide").distinct().join(twins.where("protein = twin").select("protein", "n"), "protein")
    bits = sets.groupBy("protein").agg(bit(3).alias("b1"), bit(4).alias("b2"))
    marked = cut_lineage(sets.join(bits, "protein"))
    sets = marked.select("protein", "peptide", "n")
    spread = sets.groupBy("peptide").agg(F.count(F.lit(1)).alias("f"))
    rare = marked.join(spread, "peptide").groupBy("protein", "n", "b1", "b2").agg(F.min_by("peptide", F.struct("f", "peptide")).alias("peptide"))
    holders = marked.select("peptide", F.col("protein").alias("parent"), F.col("n").alias("m"), F.col("b1").alias("p1"), F.col("b2").alias("p2"))
    inside = (F.col("m") > F.col("n")) & (F.col("b1").bitwiseAND(F.bitwise_not("p1")) == 0) & (F.col("b2").bitwiseAND(F.bitwise_not("p2")) == 0)
    candidates = join_skewed(holders, rare, "peptide", "parent", "inner").where(inside).select("protein", "n", "parent")
    asked = candidates.join(sets.select("protein", "peptide"), "protein")
    has = asked.join(sets.select(F.col("protein").alias("parent"), "peptide"), ["parent", "peptide"])
    return has.groupBy("protein", "n", "parent").agg(F.count(F.lit(1)).alias("s")).where("s = n").select("protein", "parent")


def contained_proteins(peptides: DataFrame) -> DataFrame:
    """(protein, n_peptides, twin, parent): of each protein its class of equals and the largest protein that has all its peptides and more.

    One row a protein; ``twin`` is the first of its equals (itself, if it has none), ``parent`` null if there is none; among parents of
    equal size the first by name. Repeated pairs count once.
    """
    twins = equal_sets(peptides)
    sizes = twins.select(F.col("protein").alias("parent"), F.col("n").alias("m"))
    # the largest, then the first by name
    ranked = parents_of_sets(peptides, twins).join(sizes, "parent").groupBy("protein").agg(F.min_by("parent", F.struct(-F.col("m"), "parent")).alias("parent"))
    return twins.join(ranked.withColumnRenamed("protein", "twin"), "twin", "left").select("protein", F.col("n").alias("n_peptides"), "twin", "parent")


def group_proteins(peptides: DataFrame, decoy_prefix: str = "decoy_", has_decoys: bool = True) -> ProteinTables:
    """Groups of proteins that the peptides can't tell apart, from (protein, peptide).

    A protein founds a group if no other has all its peptides and more, and none before it by name the same ones; every other protein
    belongs to each group whose founder has all its peptides. Nulls don't take part; repeated pairs count once; extra columns are passed over.
    """
    # made once: a dozen steps start from the pairs
    peptides = cut_lineage(peptides.select("protein", "peptide").where("protein is not null and peptide is not null").distinct())
    twins = cut_lineage(equal_sets(peptides))
    inside = cut_lineage(parents_of_sets(peptides, twins))
    free = twins.where("protein = twin").select("protein").join(inside.select("protein").distinct(), "protein", "left_anti").select(F.col("protein").alias("founder"))
    roots = inside.withColumnRenamed("parent", "founder").join(free, "founder").unionByName(free.select("founder", F.col("founder").alias("protein")))
    members = cut_lineage(twins.join(roots.withColumnRenamed("protein", "twin"), "twin").select("founder", "protein", "n"))
    # the founders' peptides are all there are; a peptide is in as many groups as founders have it
    of = peptides.join(members.where("founder = protein").select("founder", "protein"), "protein").select("peptide", "founder")
    per = of.groupBy("peptide").agg(F.min("founder").alias("founder"), F.max("founder").alias("last"))
    unique = per.where("founder = last").select("peptide", "founder")
    shared = of.join(per.where("founder <> last").select("peptide"), "peptide", "left_semi")
    targets = peptides.select("protein").distinct().where(~F.col("protein").startswith(decoy_prefix))
    pairs = targets.select(F.col("protein").alias("target"), F.concat(F.lit(decoy_prefix), "protein").alias("decoy"))
    return ProteinTables(unique, shared, members, pairs, decoy_prefix, has_decoys)


def match_decoys(decoys: DataFrame, targets: DataFrame, peptide: str = "peptide", seed: int | None = 1) -> DataFrame:
    """(decoy, target): each decoy peptide with a target of the same residues, each target used once at most.

    Both are taken in a seeded order, or by name if ``seed`` is None. Repeated peptides count once.
    """
    from pyspark.sql import Window

    def ranked(df: DataFrame, name: str) -> DataFrame:
        d = df.select(F.col(peptide).alias(name)).distinct().withColumn("key", composition_key(F.col(name)))
        return d.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*([] if seed is None else [F.xxhash64(name, F.lit(seed))]), name)))

    return ranked(decoys, "decoy").join(ranked(targets, "target"), ["key", "rank"]).select("decoy", "target")


def picked_proteins(psms: DataFrame, proteins: ProteinTables, peptide: str, score: str, target: str, row_id: str, seed: int = 1, check: bool = True) -> DataFrame:
    """(protein_group, best_peptide, stripped_sequence, score, target): the better of each pair of target and decoy protein group.

    Peptides that belong to no single group are left out; shared ones are expected, but if the others that can't be matched are more than
    10 % of the rows, or of decoys 5 %, a ValueError says so. Without decoys in the database, decoy peptides are matched to targets with the same residues.
    """
    seq = "stripped_sequence"
    every = strip_peptides(psms, peptide)
    # the best of a pair is the best of its sequences' best rows, so a hot peptide is one row before any join
    bare = best_per_group(every, [seq, target], score, None, [row_id])
    by_target = bare.join(proteins.unique.withColumnRenamed("peptide", seq), seq, "left").withColumn("_matched", F.lit(False))
    if not proteins.has_decoys:
        found = match_decoys(bare.where(~F.col(target)).select(F.col(seq).alias("peptide")), proteins.unique, seed=seed)
        decoy_map = found.join(proteins.unique.withColumnRenamed("peptide", "target"), "target").select(F.col("decoy").alias(seq), F.col("founder").alias("_decoy_founder"))
        by_target = by_target.join(decoy_map, seq, "left").withColumn("founder", F.when(F.col(target), F.col("founder")).otherwise(F.col("_decoy_founder"))).withColumn("_matched", ~F.col(target)).drop("_decoy_founder")
    if check:
        counted = every.groupBy(seq, target).agg(F.count(F.lit(1)).alias("_n"))
        unknown = by_target.where(F.col("founder").isNull()).join(proteins.shared.select(F.col("peptide").alias(seq)), seq, "left_anti").select(seq, target, F.lit(1).alias("_lost"))
        gone, decoy = F.col("_lost") == 1, ~F.col(target)
        total = lambda on: F.coalesce(F.sum(F.when(on, F.col("_n"))), F.lit(0))
        lost, n, lost_decoys, decoys = counted.join(unknown, [seq, target], "left").agg(total(gone), total(F.lit(True)), total(gone & decoy), total(decoy)).first()
        if lost > 0.1 * max(1, n):
            raise ValueError(f"{lost} of {n} rows' peptides are in no protein of the database; was it digested like the spectra's sample?")
        if proteins.has_decoys and lost_decoys > 0.05 * max(1, decoys):
            raise ValueError(f"{lost_decoys} of {decoys} decoys are in no protein of the database; does it have the decoys that were searched?")
        if lost:
            log.warning("%d of %d rows' peptides are in no protein of the database", lost, n)
    known = by_target.where(F.col("founder").isNotNull())
    first, prefix = F.col("founder"), proteins.decoy_prefix
    pair = F.when(first.startswith(prefix), F.substring(first, F.lit(len(prefix) + 1), F.length(first))).otherwise(first)
    best = best_per_group(known.withColumn("_pair", pair), ["_pair"], score, target, [row_id])
    name = F.when(F.col("_matched"), F.col("decoy_group")).otherwise(F.col("protein_group"))
    return best.join(proteins.names, "founder").select(name.alias("protein_group"), F.col(peptide).alias("best_peptide"), seq, score, target)


def proteins_from_column(psms: DataFrame, peptide: str, proteins: str) -> DataFrame:
    """(protein, peptide) from packed protein names, split by ``split_packed``, where there is no sequence database."""
    rows = psms.where(F.col(peptide).isNotNull()).select(F.col(peptide).alias("peptide"), F.col(proteins).alias("packed"))
    return split_packed(rows, "packed", ["peptide"], value="protein").select("protein", "peptide").distinct()
