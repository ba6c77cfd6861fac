"""Reading tables by their suffix: delimited text, ragged PIN files, Parquet; results of earlier runs; saved models."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peptrail.dataset import PsmDataset

# Suffixes that hold tab-separated tables.
DELIMITED = ("tsv", "tab", "pin", "peptides", "psms", "proteins", "modifiedpeptides", "peptidegroups", "modified_peptides", "peptide_groups", "precursors")


def suffix_of(path: str) -> str:
    name = PurePosixPath(path).name.lower()
    return PurePosixPath(name[:-3] if name.endswith(".gz") else name).suffix.lstrip(".")


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", columns: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A delimited table with a header; types from all rows unless a schema is given. Surplus trailing fields of a line are cut off."""
    reader = spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def _head(spark: SparkSession, path: str) -> list[str]:
    for r in spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).limit(1).collect():
        return r[0].rstrip("\r").lstrip("﻿").split("\t")
    raise ValueError(f"{path} has no header")


def is_ragged_pin(spark: SparkSession, path: str) -> bool:
    """Whether some line has more fields than the header, whose last column is the proteins; ValueError if one has fewer."""
    head = _head(spark, path)
    if not head[-1].lower().startswith("protein"):
        return False
    n = F.size(F.split("value", "\t"))
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)|^DefaultDirection\b"))
    low, high = lines.agg(F.min(n), F.max(n)).first()
    if low is not None and low < len(head):
        raise ValueError(f"{path} has a line with {low} of {len(head)} fields")
    return high is not None and high > len(head)


def read_ragged_pin(spark: SparkSession, path: str, delimiter: str = ":") -> DataFrame:
    """A PIN file whose lines list proteins in further fields: they are joined in the last column. Types as in ``read_delimited``.

    Comments, blank lines and DefaultDirection rows are no data.
    """
    head = _head(spark, path)
    n = len(head)
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)|^DefaultDirection\b")).select(cells.alias("c"))
    lines = lines.where(~(F.col("c") == F.array(*map(F.lit, head))))
    raw = lines.select(*[F.element_at("c", i + 1).alias(c) for i, c in enumerate(head[:-1])], F.array_join(F.slice("c", n, F.greatest(F.size("c") - n + 1, F.lit(1))), delimiter).alias(head[-1]))
    return with_inferred_types(raw, head[:-1])


def with_inferred_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """String columns as long or double where every value is one; one aggregate over all of them."""
    if not columns:
        return df
    v = lambda c: F.nullif(F.trim(f"`{c}`"), F.lit(""))
    tests = [x for i, c in enumerate(columns) for x in (F.bool_and(v(c).rlike(r"^[+-]?\d{1,18}$")).alias(f"w{i}"), F.bool_and(v(c).try_cast("double").isNotNull()).alias(f"d{i}"))]
    row = df.agg(*tests).first()
    out = {c: v(c).cast("long") if row[f"w{i}"] else v(c).cast("double") for i, c in enumerate(columns) if row[f"w{i}"] or row[f"d{i}"]}
    return df.withColumns(out) if out else df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """A table by its suffix (.gz is looked through); an unknown suffix is read as tab-separated, with a warning."""
    kind = suffix_of(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        df = read_delimited(spark, path, ",")
    elif kind == "pin":
        try:
            df = read_ragged_pin(spark, path) if is_ragged_pin(spark, path) else read_delimited_pin(spark, path)
        except ValueError as e:
            warnings.warn(f"{e}; it is read as plain delimited text", stacklevel=2)
            df = read_delimited(spark, path)
    else:
        if kind not in DELIMITED:
            warnings.warn(f"unknown suffix of {path}; it is read as tab-separated text", stacklevel=2)
        df = read_delimited(spark, path)
    df = df.withColumnsRenamed(renames) if renames else df
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_delimited_pin(spark: SparkSession, path: str) -> DataFrame:
    """A PIN file with one field a column; a DefaultDirection row isn't data."""
    df = read_delimited(spark, path)
    first = df.columns[0]
    if df.schema[first].dataType.simpleString() == "string" and df.where(F.col(f"`{first}`") == "DefaultDirection").limit(1).count():
        return read_ragged_pin(spark, path)
    return df


def read_pin(spark: SparkSession, paths: str | Sequence[str], drop_na_features: bool = True, **named: str | None) -> list[PsmDataset]:
    """A dataset of each file, with roles inferred from the names of its columns (keywords name single roles)."""
    every = [paths] if isinstance(paths, str) else list(paths)
    return [PsmDataset.of(read_table(spark, p), name=PurePosixPath(p).stem, drop_na_features=drop_na_features, **named) for p in every]


def read_percolator(spark: SparkSession, path: str) -> DataFrame:
    """A PIN file as a DataFrame."""
    return read_table(spark, path)


def in_memory(spark: SparkSession, rows: object, columns: Sequence[str] | None = None) -> DataFrame:
    """A DataFrame of pandas data, a one-dimensional array or a list of rows; wider arrays than one column need their names."""
    import numpy as np
    import pandas as pd

    if isinstance(rows, pd.Series):
        rows = rows.to_frame(rows.name or "value")
    if isinstance(rows, np.ndarray):
        if rows.ndim > 2 or (rows.ndim == 2 and rows.shape[1] != 1):
            raise ValueError("only one column of values can be read from an array")
        rows = pd.DataFrame({(columns or ["value"])[0]: rows.reshape(-1)})
    return spark.createDataFrame(rows, list(columns) if columns and not hasattr(rows, "columns") else None)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that match a pattern in any file system that Spark reads, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


# Names that earlier runs' columns get.
RESULT_NAMES = {"PSMId": "psm_id", "SpecId": "psm_id", "q-value": "q_value", "q_value": "q_value", "posterior_error_prob": "pep", "proteinIds": "proteins", "Proteins": "proteins", "Peptide": "peptide", "score": "score"}


def read_results(spark: SparkSession, folder: str, level: str = "psm", exclude: str | None = None) -> DataFrame:
    """All targets and decoys of a level from the result files in a folder, with ``is_decoy``.

    Files are named ``*.targets.<level>s.<suffix>`` and ``*.decoys...``; those of a file root ``exclude`` are passed over. Parquet beside
    text is an error, as is a folder without such files.
    """
    found = {}
    for kind, decoy in (("targets", False), ("decoys", True)):
        for p in list_paths(spark, f"{folder}/*{kind}.{level}s*"):
            if not (exclude and p.rsplit("/", 1)[-1].startswith(exclude)):
                found[p] = decoy
    suffixes = {suffix_of(p) == "parquet" for p in found}
    if len(suffixes) != 1:
        raise ValueError(f"{folder} has {'Parquet and text' if suffixes else 'no'} files of level {level}")
    parts = [read_table(spark, p).withColumn("is_decoy", F.lit(decoy)) for p, decoy in found.items()]
    out = parts[0].withColumnsRenamed(RESULT_NAMES)
    for p in parts[1:]:
        out = out.unionByName(p.withColumnsRenamed(RESULT_NAMES), allowMissingColumns=True)
    return out
