"""Confidence of scored records on all levels: competition, rollup, q-values, error probabilities, outputs."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.dataset import ROW_ID, PsmDataset
from peptrail.learn.brew import best_features
from peptrail.operators.competition import best_per_group, psm_competition, reachable_levels, rollup
from peptrail.operators.peps import peps
from peptrail.operators.proteins import ProteinTables, picked_proteins
from peptrail.operators.qvalues import qvalues
from peptrail.session import cut_lineage
from peptrail.sinks.writers import output_columns, write_sqlite, write_target_decoy
from peptrail.streaming.histogram_confidence import histogram_confidence

log = logging.getLogger(__name__)

# The names of result levels by the role that is their key.
LEVEL_NAMES = {"modifiedpeptide": "modifiedpeptides", "precursor": "precursors", "peptidegroup": "peptidegroups"}


@dataclass
class ConfidenceResult:
    """One table a level: psms, peptides, further levels, proteins."""

    levels: dict[str, DataFrame]
    dataset: PsmDataset
    written: dict[str, dict[str, str]] = field(default_factory=dict)

    def read(self, level: str) -> DataFrame:
        if level not in self.levels:
            raise ValueError(f"no level {level}; there are {', '.join(self.levels)}")
        return self.levels[level]

    @property
    def psms(self) -> DataFrame:
        return self.read("psms")

    @property
    def peptides(self) -> DataFrame:
        return self.read("peptides")

    @property
    def proteins(self) -> DataFrame:
        return self.read("proteins")


def assign_confidence(
    dataset: PsmDataset, score: str | None = None, eval_fdr: float = 0.01, proteins: ProteinTables | None = None, qvalue_algorithm: str = "tdc", peps_algorithm: str = "qvality",
    deduplication: bool = True, do_rollup: bool = True, stream_confidence: bool = False, peps_error: bool = False,
) -> ConfidenceResult:
    """Tables of all levels with score, q_value and pep.

    Without ``score`` (a column, higher is better) the best single feature at eval_fdr is the score, negated if lower is better. Peptide
    and further levels come from the winners of the spectra (from all rows without ``deduplication``). ``stream_confidence`` takes q-values
    and error probabilities from histograms in two passes, which needs peps_algorithm hist_nnls.
    """
    roles, df = dataset.roles, dataset.df
    if stream_confidence and peps_algorithm != "hist_nnls":
        raise ValueError("streaming confidence needs hist_nnls")
    if score is None:
        best = best_features(df, list(roles.features), roles.target, eval_fdr).first()
        value = F.col(f"`{best['feature']}`").cast("double")
        df = df.withColumn("score", value if best["descending"] else -value)
    elif score != "score":
        df = df.withColumn("score", F.col(f"`{score}`").cast("double"))
    y = roles.target
    # every level and each estimate reads the winners: they are made once
    psms = cut_lineage(psm_competition(df, list(roles.spectrum), "score", y, ROW_ID, deduplication))
    tables = {"psms": psms}
    if do_rollup:
        keys = {"peptides": [roles.peptide]} | {LEVEL_NAMES[c.lower()]: [c] for c in roles.levels}
        rolled = cut_lineage(rollup(psms, keys, "score", y, ROW_ID))
        tables |= {name: rolled.where(F.col("level") == name).drop("level") for name in keys}
    if proteins is not None:
        tables["proteins"] = picked_proteins(psms, proteins, roles.peptide, "score", y, ROW_ID)

    def rate(t: DataFrame) -> DataFrame:
        if stream_confidence:
            return histogram_confidence(t, "score", y)
        if qvalue_algorithm == "from_peps":
            return qvalues(peps(t, "score", y, peps_algorithm, peps_error=peps_error), "score", y, "from_peps", pep="pep")
        return peps(qvalues(t, "score", y, qvalue_algorithm), "score", y, peps_algorithm, peps_error=peps_error)

    return ConfidenceResult({name: rate(t) for name, t in tables.items()}, dataset)


def rollup_results(df: DataFrame, base: str, qvalue_algorithm: str = "tdc", peps_algorithm: str = "qvality", stream_confidence: bool = False, score: str = "score", target: str = "target") -> dict[str, DataFrame]:
    """Tables of the levels that ``base`` can be rolled up to, itself first, with q_value and pep, from the results of any number of runs.

    A level's key is the column of its name (psm_id or row_id for psm), in any case and with or without underscores; levels without a column
    are passed over with a warning. Equal rows tie by a hash of the row.
    """
    by_lower = {c.lower().replace("_", ""): c for c in df.columns}
    ident = by_lower.get("rowid")
    keyed = df.withColumn("_id", F.col(f"`{ident}`") if ident else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    out = {}
    for level in reachable_levels(base):
        column = by_lower.get("psmid", ident) if level == "psm" else by_lower.get(level.replace("_", ""))
        if column is None:
            log.warning("no column for level %s; it is passed over", level)
            continue
        best = best_per_group(keyed, [column], score, target, ["_id"])
        if stream_confidence:
            rated = histogram_confidence(best, score, target)
        elif qvalue_algorithm == "from_peps":
            rated = qvalues(peps(best, score, target, peps_algorithm, peps_error=True), score, target, "from_peps", pep="pep")
        else:
            rated = peps(qvalues(best, score, target, qvalue_algorithm), score, target, peps_algorithm, peps_error=True)
        out[level] = rated.drop("_id")
    return out


def write_confidence(result: ConfidenceResult, folder: str, write_decoys: bool = False, append: bool = False, sqlite_path: str | None = None, suffix: str = ".parquet", **naming: str) -> dict[str, dict[str, str]]:
    """Targets (and decoys) of each level to ``folder``; into a result database too if one is named (no table exists for proteins)."""
    roles = result.dataset.roles
    for level, table in result.levels.items():
        result.written[level] = write_target_decoy(table, roles.target, folder, level, output_columns(roles, level), write_decoys, append, suffix=suffix, **naming)
        if sqlite_path and level != "proteins":
            write_sqlite(table.where(F.col(roles.target)), sqlite_path, level, {"psms": roles.id, "peptides": roles.peptide}.get(level) or next(c for c in roles.levels if LEVEL_NAMES[c.lower()] == level))
    return result.written
