"""Command line: re-score files and write confidence tables, or roll results of earlier runs up."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Sequence

from peptrail.functions.peptides import ENZYMES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("peptrail", description="Re-score target/decoy records and estimate their confidence.")
    p.add_argument("files", nargs="+", help="PIN, tab-separated, Parquet or PepXML files")
    p.add_argument("-d", "--dest_dir", default=".")
    p.add_argument("-w", "--max_workers", type=int, default=None, help="local cores; ignored on a cluster")
    p.add_argument("-r", "--file_root", default="")
    p.add_argument("--proteins", default=None, help="FASTA file")
    p.add_argument("--decoy_prefix", default="decoy_")
    p.add_argument("--enzyme", default="[KR]", help="pattern or name: " + ", ".join(ENZYMES))
    p.add_argument("--missed_cleavages", type=int, default=2)
    p.add_argument("--clip_nterm_methionine", action="store_true")
    p.add_argument("--min_length", type=int, default=6)
    p.add_argument("--max_length", type=int, default=50)
    p.add_argument("--semi", action="store_true")
    p.add_argument("--train_fdr", type=float, default=0.01)
    p.add_argument("--test_fdr", type=float, default=0.01)
    p.add_argument("--max_iter", type=int, default=10)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--direction", default=None)
    p.add_argument("--aggregate", action="store_true", help="append all files' tables")
    p.add_argument("--subset_max_train", type=int, default=None)
    p.add_argument("--override", action="store_true")
    p.add_argument("--save_models", action="store_true")
    p.add_argument("--load_models", nargs="+", default=None)
    p.add_argument("--keep_decoys", action="store_true")
    p.add_argument("--skip_deduplication", action="store_true")
    p.add_argument("--skip_rollup", action="store_true")
    p.add_argument("--folds", type=int, default=3)
    p.add_argument("--ensemble", action="store_true")
    p.add_argument("--peps_error", action="store_true")
    p.add_argument("--peps_algorithm", default="qvality", choices=("qvality", "kde_nnls", "hist_nnls"))
    p.add_argument("--qvalue_algorithm", default="tdc", choices=("tdc", "from_peps", "from_counts", "from_histogram"))
    p.add_argument("--open_modification_bin_size", type=float, default=None)
    p.add_argument("-v", "--verbosity", type=int, default=2, choices=(0, 1, 2, 3))
    p.add_argument("--suppress_warnings", action="store_true")
    p.add_argument("--sqlite_db_path", default=None)
    p.add_argument("--stream_confidence", action="store_true")
    p.add_argument("--suffix", default=".parquet", choices=(".parquet", ".tsv"))
    return p


def rollup_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("peptrail rollup", description="Roll results of earlier runs up to coarser levels.")
    p.add_argument("--level", required=True, choices=("psm", "precursor", "modified_peptide", "peptide", "peptide_group"))
    p.add_argument("--src_dir", default=".")
    p.add_argument("--dest_dir", default=".")
    p.add_argument("--file_root", default="rollup")
    p.add_argument("--peps_algorithm", default="qvality", choices=("qvality", "kde_nnls", "hist_nnls"))
    p.add_argument("--qvalue_algorithm", default="tdc", choices=("tdc", "from_counts", "from_peps", "from_histogram"))
    p.add_argument("--stream_confidence", action="store_true")
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("-v", "--verbosity", type=int, default=2, choices=range(4))
    p.add_argument("--suppress_warnings", action="store_true")
    p.add_argument("--suffix", default=".parquet", choices=(".parquet", ".tsv"))
    return p


def _session(cores: int | None):  # noqa: ANN202
    from pyspark.sql import SparkSession

    from peptrail.session import local_session

    return SparkSession.getActiveSession() or local_session(cores or os.cpu_count() or 1)


def run(args: argparse.Namespace) -> dict:
    """Runs the main command; returns the paths written, by file."""
    from pyspark.sql import functions as F

    from peptrail.confidence import assign_confidence, write_confidence
    from peptrail.dataset import PsmDataset
    from peptrail.learn.brew import brew, brew_joint, load_models, save_models
    from peptrail.sources.fasta import read_proteins
    from peptrail.sources.pepxml import read_pepxml
    from peptrail.sources.tables import read_pin, suffix_of

    if args.stream_confidence and args.peps_algorithm != "hist_nnls":
        raise ValueError("streaming confidence needs --peps_algorithm hist_nnls")
    spark = _session(args.max_workers)
    proteins = None
    if args.proteins:
        proteins = read_proteins(
            spark, args.proteins, args.decoy_prefix, ENZYMES.get(args.enzyme, args.enzyme), args.missed_cleavages,
            clip_nterm_methionine=args.clip_nterm_methionine, min_length=args.min_length, max_length=args.max_length, semi=args.semi,
        )
    datasets = []
    for path in args.files:
        if suffix_of(path) in ("xml", "pepxml"):
            df = read_pepxml(spark, path, args.decoy_prefix, open_modification_bin_size=args.open_modification_bin_size)
            df = df.withColumnsRenamed({"label": "Label", "scan": "ScanNr", "peptide": "Peptide", "proteins": "Proteins"}).withColumn("SpecId", F.concat_ws(".", "ms_data_file", "ScanNr", "Peptide"))
            datasets.append(PsmDataset.of(df, name=os.path.basename(path), filename="ms_data_file", charge="charge", id="SpecId"))
        else:
            datasets += read_pin(spark, path)
    options = {k: getattr(args, k) for k in ("train_fdr", "test_fdr", "folds", "max_iter", "seed", "direction", "override", "subset_max_train", "ensemble")}
    models = [m for p in args.load_models for m in load_models(p)] if args.load_models else None
    results = brew_joint(datasets, models=models, **options) if len(datasets) > 1 else [brew(datasets[0], models=models, **options)]
    os.makedirs(args.dest_dir, exist_ok=True)
    if args.save_models:
        save_models(results[0].models, os.path.join(args.dest_dir, f"{args.file_root + '.' if args.file_root else ''}models.json"))
    written = {}
    for i, (ds, r) in enumerate(zip(datasets, results)):
        scored = PsmDataset(r.scored, ds.roles, ds.name)
        c = assign_confidence(
            scored, "score", args.test_fdr, proteins, args.qvalue_algorithm, args.peps_algorithm, not args.skip_deduplication, not args.skip_rollup, args.stream_confidence, args.peps_error
        )
        prefix = "" if args.aggregate or len(datasets) == 1 else ds.name
        written[ds.name] = write_confidence(c, args.dest_dir, args.keep_decoys, args.aggregate and i > 0, args.sqlite_db_path, args.suffix, file_root=args.file_root, prefix=prefix)
    return written


def run_rollup(args: argparse.Namespace) -> dict[str, dict[str, str]]:
    """Runs the rollup command; returns the paths written, by level."""
    from pyspark.sql import functions as F

    from peptrail.confidence import rollup_results
    from peptrail.sinks.writers import write_target_decoy
    from peptrail.sources.tables import read_results

    df = read_results(_session(None), args.src_dir, args.level, args.file_root + ".").withColumn("target", ~F.col("is_decoy"))
    df = df.drop("q_value", "pep", "is_decoy")
    written = {}
    for level, rated in rollup_results(df, args.level, args.qvalue_algorithm, args.peps_algorithm, args.stream_confidence).items():
        columns = [c for c in rated.columns if c != "target"]
        written[level] = write_target_decoy(rated, "target", args.dest_dir, f"{level}s", columns, True, file_root=args.file_root, suffix=args.suffix)
    return written


def _prepare(args: argparse.Namespace) -> None:
    logging.basicConfig(level=[logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG][args.verbosity])
    if args.suppress_warnings:
        import warnings

        warnings.simplefilter("ignore")


def main(argv: Sequence[str] | None = None) -> int:
    """Exit codes: 0; 250 for wrong input or arguments' values; 252 for anything else."""
    argv = list(sys.argv[1:] if argv is None else argv)
    try:
        if argv[:1] == ["rollup"]:
            args = rollup_parser().parse_args(argv[1:])
            _prepare(args)
            run_rollup(args)
        else:
            args = parser().parse_args(argv)
            _prepare(args)
            run(args)
    except (RuntimeError, ValueError) as e:
        logging.getLogger(__name__).error("%s", e)
        return 250
    except Exception:
        logging.getLogger(__name__).exception("failed")
        return 252
    return 0


if __name__ == "__main__":
    sys.exit(main())
