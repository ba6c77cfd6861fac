"""Writing results: delimited text, Parquet, SQLite, FASTA, and a table for label-free quantification."""

from __future__ import annotations

import os
import shutil
import sqlite3
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.functions.peptides import base_sequence, basename
from peptrail.roles import ColumnRoles

# The tables of a result database, their key and their columns for q-value, score and error probability.
SQLITE_TABLES = {
    "psms": ("CANDIDATE", "CANDIDATE_ID", "PSM_FDR", "SVM_SCORE", "POSTERIOR_ERROR_PROBABILITY"),
    "precursors": ("PRECURSOR_VALIDATION", "PCM_ID", "FDR", "SVM_SCORE", "PEP"),
    "modifiedpeptides": ("MODIFIED_PEPTIDE_VALIDATION", "MODIFIED_PEPTIDE_ID", "FDR", "SVM_SCORE", "PEP"),
    "peptides": ("PEPTIDE_VALIDATION", "PEPTIDE_ID", "FDR", "SVM_SCORE", "PEP"),
    "peptidegroups": ("PEPTIDE_GROUP_VALIDATION", "PEPTIDE_GROUP_ID", "FDR", "SVM_SCORE", "PEP"),
}


def write_table(df: DataFrame, path: str, mode: str = "error", single_file: bool = False) -> None:
    """df as a folder of files by the path's suffix (.parquet, else tab-separated with a header); mode as Spark's.

    ``single_file``: one file at exactly that path, for results that are small by nature (it passes through one task). A database needs
    ``write_sqlite``, which knows its tables.
    """
    if path.endswith((".db", ".sqlite")):
        raise ValueError(f"{path} is a database; use write_sqlite")
    parquet = path.endswith(".parquet")

    def write(d: DataFrame, p: str, m: str) -> None:
        w = d.write.mode(m)
        w.parquet(p) if parquet else w.option("sep", "," if path.endswith(".csv") else "\t").option("header", True).option("emptyValue", "").csv(p)

    if not single_file:
        write(df, path, mode)
        return
    if mode == "append" and os.path.exists(path):
        raise ValueError("a single file can't be appended to")
    if mode == "error" and os.path.exists(path):
        raise FileExistsError(path)
    parts = path + "-parts"
    write(df.coalesce(1), parts, "overwrite")
    (part,) = [f for f in os.listdir(parts) if f.startswith("part-")] or [None]
    os.replace(os.path.join(parts, part), path)
    shutil.rmtree(parts)


def output_path(folder: str, level: str, kind: str, file_root: str = "", prefix: str = "", suffix: str = ".parquet") -> str:
    """``folder/[file_root.][prefix.]targets|decoys.level<suffix>``."""
    name = "".join(f"{p}." for p in (file_root.rstrip("."), prefix) if p) + f"{kind}.{level}{suffix}"
    return os.path.join(folder, name)


def output_columns(roles: ColumnRoles, level: str) -> list[str]:
    """The columns of a result table, in order."""
    if level == "proteins":
        return ["protein_group", "best_peptide", "stripped_sequence", "score", "q_value", "pep"]
    return [c for c in (roles.id, *roles.spectrum, roles.peptide, *roles.levels, "score", "q_value", "pep", roles.protein) if c]


def write_target_decoy(df: DataFrame, target: str, folder: str, level: str, columns: list[str], write_decoys: bool = False, append: bool = False, **naming: str) -> dict[str, str]:
    """Targets and, if wanted, decoys to files of their own; missing columns are null. With ``append`` later data join earlier ones."""
    filled = df.select(target, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])
    out = {}
    for kind, rows in (("targets", filled.where(F.col(target))), ("decoys", filled.where(~F.col(target)))):
        if kind == "targets" or write_decoys:
            out[kind] = output_path(folder, level, kind, **naming)
            write_table(rows.select(*columns), out[kind], "append" if append else "overwrite")
    return out


def write_sqlite(df: DataFrame, path: str, level: str, key: str, q_value: str = "q_value", score: str = "score", pep: str = "pep", batch: int = 10_000) -> int:
    """Rows into an existing result database: updates of the candidates for level ``psms``, inserts for the others.

    SQLite has one writer, so rows stream through the driver partition by partition. An unknown level or a missing table is a ValueError.
    """
    if level not in SQLITE_TABLES:
        raise ValueError(f"no table for level {level}")
    table, ident, *measures = SQLITE_TABLES[level]
    if level == "psms":
        sql = f"UPDATE {table} SET {', '.join(f'{m} = ?' for m in measures)} WHERE {ident} = ?"  # noqa: S608
    else:
        sql = f"INSERT INTO {table} ({', '.join(measures)}, {ident}) VALUES (?, ?, ?, ?)"  # noqa: S608
    db = sqlite3.connect(path)
    try:
        if not db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone():
            raise ValueError(f"{path} has no table {table}")
        n = 0
        rows: Iterable = df.select(q_value, score, pep, key).toLocalIterator(prefetchPartitions=True)
        held = []
        for r in rows:
            held.append(tuple(r))
            if len(held) == batch:
                db.executemany(sql, held)
                n, held = n + len(held), []
        db.executemany(sql, held)
        db.commit()
        return n + len(held)
    finally:
        db.close()


def to_flashlfq(source: DataFrame, peptides: DataFrame, roles: ColumnRoles, eval_fdr: float = 0.01) -> DataFrame:
    """The table that FlashLFQ reads: accepted peptides with file, sequences, mass, retention time, charge and proteins.

    peptides: the result of level peptides with q_value. It is joined to the source one to one on spectrum and peptide; a duplicate on
    either side is a ValueError. File, mass, retention time and charge need roles. Rows without proteins are left out.
    """
    needed = {"filename": roles.filename, "calcmass": roles.calcmass, "rt": roles.rt, "charge": roles.charge, "protein": roles.protein}
    if missing := [k for k, v in needed.items() if not v]:
        raise ValueError(f"no column for {', '.join(missing)}")
    on = list(dict.fromkeys([*roles.spectrum, roles.peptide]))
    accepted = peptides.where(F.col("q_value") <= eval_fdr).select(*on)
    if accepted.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError("accepted peptides aren't unique by spectrum and peptide")
    wanted = source.select(*dict.fromkeys([*on, *needed.values()])).join(accepted, on, "left_semi")
    if wanted.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError("the source isn't unique by spectrum and peptide")
    return wanted.where(F.col(roles.protein).isNotNull()).select(
        basename(F.col(roles.filename)).alias("File Name"), base_sequence(F.col(roles.peptide)).alias("Base Sequence"), F.col(roles.peptide).alias("Full Sequence"),
        F.col(roles.calcmass).alias("Peptide Monoisotopic Mass"), F.col(roles.rt).alias("Scan Retention Time"), F.col(roles.charge).alias("Precursor Charge"),
        F.replace(F.col(roles.protein), F.lit("\t"), F.lit("; ")).alias("Protein Accession"),
    )


def fasta_lines(df: DataFrame, name: str = "protein", sequence: str = "sequence") -> DataFrame:
    """(value): FASTA entries with lines of 70 residues."""
    wrapped = F.regexp_replace(F.regexp_replace(F.col(sequence), "(.{70})", "$1\n"), "\n$", "")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, name: str = "protein", sequence: str = "sequence") -> None:
    fasta_lines(df, name, sequence).write.mode("error").text(path)
