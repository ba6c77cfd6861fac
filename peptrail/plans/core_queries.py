"""Queries of the confidence engine's own operators, over whole tables, each with the SQL that says the same."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.confidence import assign_confidence, rollup_results
from peptrail.dataset import PsmDataset
from peptrail.functions import peptides as pep_fn
from peptrail.functions import search_features as feat
from peptrail.learn.brew import LinearModel, best_features, brew, calibrate
from peptrail.operators import competition as comp
from peptrail.operators import histogram as hist
from peptrail.operators import peps as pep_ops
from peptrail.operators import proteins as prot
from peptrail.operators import qvalues as qv
from peptrail.roles import ColumnRoles, infer_roles
from peptrail.sinks.writers import fasta_lines, to_flashlfq
from peptrail.streaming.histogram_confidence import histogram_confidence, stream_events

FEATURES = ("lnrsp", "deltlcn", "deltcn", "sp", "ionfrac", "refactoredxcorr", "neglog10pvalue", "neglog10resevpvalue", "neglog10combinepvalue", "peplen", "enzn", "enzc", "enzint", "lnnumdsp", "dm", "absdm")
#: A fixed linear model for the queries on scores.
WEIGHTS = {"refactoredxcorr": 1.5, "neglog10combinepvalue": 0.25, "absdm": -2.0}
BINS = 100

# The records: scored rows with peptide, spectrum (run and scan) and target.
PSM_SQL = """SELECT row_id, run_id, scannr, expmass, calcmass, peptide, proteins, label = 1 AS target, refactoredxcorr AS score, absdm
    FROM psms WHERE refactoredxcorr IS NOT NULL AND NOT isnan(refactoredxcorr) AND peptide IS NOT NULL AND label IS NOT NULL"""


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _psm(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "psms").where("refactoredxcorr is not null and not isnan(refactoredxcorr) and peptide is not null and label is not null")
    return p.select("row_id", "run_id", "scannr", "expmass", "calcmass", "peptide", "proteins", (F.col("label") == 1).alias("target"), F.col("refactoredxcorr").alias("score"), "absdm")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def tdc_sql(source: str, score: str = "score", descending: bool = True, parts: str = "") -> str:
    """CTEs up to q(parts, s, t, d, q) over a source with score and target."""
    best, worst = ("DESC", "ASC") if descending else ("ASC", "DESC")
    by, comma = (f"PARTITION BY {parts} " if parts else ""), (f"{parts}, " if parts else "")
    return f"""src AS ({source}),
    g AS (SELECT {comma}{score}::FLOAT AS s, count(*) FILTER (target) AS t, count(*) FILTER (NOT target) AS d FROM src WHERE {score} IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, sum(t) OVER w AS ct, sum(d) OVER w AS cd FROM g WINDOW w AS ({by}ORDER BY s {best} ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, least(1.0::DOUBLE, CASE WHEN ct > 0 THEN (cd + 1) / ct::DOUBLE ELSE 1 END, CASE WHEN d > 0 AND ct - t > 0 THEN (cd - d + 2) / (ct - t)::DOUBLE ELSE 1 END)::FLOAT AS fdr FROM c),
    m AS (SELECT *, min(fdr) OVER w AS mq, first_value(fdr) OVER w AS worst FROM f WINDOW w AS ({by}ORDER BY s {worst} ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT {comma}s, t, d, CASE WHEN mq = worst THEN 1.0::DOUBLE ELSE mq::DOUBLE END AS q FROM m)"""  # noqa: S608


WINNERS_SQL = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, scannr ORDER BY score DESC, target ASC, row_id) AS rn FROM ({PSM_SQL})) WHERE rn = 1"""  # noqa: S608


def tdc_qvalues(spark: SparkSession, sf: str) -> DataFrame:
    return _round(qv.tdc(_psm(spark, sf), "score", "target").select("row_id", "q_value"), "q_value")


def tdc_qvalues_asc(spark: SparkSession, sf: str) -> DataFrame:
    return _round(qv.tdc(_psm(spark, sf).where("absdm is not null"), "absdm", "target", False).select("row_id", "q_value"), "q_value")


def qvalues_from_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _round(qv.from_counts(_psm(spark, sf), "score", "target").select("row_id", "q_value"), "q_value")


def _q_from_peps(spark: SparkSession, sf: str) -> DataFrame:
    df = _psm(spark, sf).withColumn("pep", 1 / (1 + F.exp(F.col("score") - 2)))
    return _round(qv.from_peps(df, "score", "target", "pep"), "q_value")


def qvalues_from_peps(spark: SparkSession, sf: str) -> DataFrame:
    """Targets only, as its SQL has it; qvalues_from_peps_all has the decoys, too."""
    return _q_from_peps(spark, sf).where("target").select("row_id", "q_value")


def qvalues_from_peps_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every record: a decoy's value is interpolated between the targets around it."""
    return _q_from_peps(spark, sf).select("row_id", "q_value")


def qvalues_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _round(qv.from_histogram(_psm(spark, sf), "score", "target", bins=BINS, clip=None).select("row_id", "q_value"), "q_value")


def streaming_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Q-values and error probabilities from a two-pass histogram."""
    return _round(histogram_confidence(_psm(spark, sf), "score", "target").select("row_id", "q_value", "pep"), "q_value", "pep")


def stream_event_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The histogram of events' values as the state of a stream: purchases against other events."""
    return stream_events(spark, f"{sf}/events.parquet")


def td_histogram(spark: SparkSession, sf: str) -> DataFrame:
    df = _psm(spark, sf)
    lo, hi = df.agg(F.min("score"), F.max("score")).first()
    return hist.histogram_rows(df, "score", "target", lo, hi, BINS)


def score_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _round(hist.score_statistics(_psm(spark, sf), "score"), "sum", "mean", "var", "sd")


def bin_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Number of bins by each rule."""
    r = hist.score_statistics(_psm(spark, sf), "score").first()
    return spark.createDataFrame([(k, hist.bin_count(r["n"], r["min"], r["max"], r["sd"], k)) for k in ("sturges", "terrell_scott", "scott")], "rule string, bins int")


def update_labels(spark: SparkSession, sf: str) -> DataFrame:
    return qv.update_labels(_psm(spark, sf), "score", "target", 0.05).select("row_id", "label")


def training_set(spark: SparkSession, sf: str) -> DataFrame:
    return qv.training_rows(qv.update_labels(_psm(spark, sf), "score", "target", 0.05)).select("row_id", "y")


def psm_competition(spark: SparkSession, sf: str) -> DataFrame:
    return comp.psm_competition(_psm(spark, sf), ["run_id", "scannr"], "score", "target", "row_id").select("row_id", "run_id", "scannr", "score", "target")


def no_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return comp.psm_competition(_psm(spark, sf), ["run_id", "scannr"], "score", "target", "row_id", False).select("row_id", "score", "target")


def _winners(spark: SparkSession, sf: str) -> DataFrame:
    return comp.psm_competition(_psm(spark, sf), ["run_id", "scannr"], "score", "target", "row_id")


def rollup_multi_level(spark: SparkSession, sf: str) -> DataFrame:
    w = _winners(spark, sf).withColumn("bare", pep_fn.base_sequence(F.col("peptide")))
    return comp.rollup(w, {"peptide": ["peptide"], "sequence": ["bare"], "run_sequence": ["run_id", "bare"]}, "score", "target", "row_id").select("level", "row_id", "score", "target")


def peptide_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Competition within spectra, rollup to peptides, q-values of both targets and decoys."""
    best = comp.best_per_group(_winners(spark, sf), ["peptide"], "score", "target", ["row_id"])
    return _round(qv.tdc(best, "score", "target").select("row_id", "peptide", "score", "target", "q_value"), "q_value")


def target_decoy_split(spark: SparkSession, sf: str) -> DataFrame:
    t, d = comp.target_decoy_split(_winners(spark, sf), "target")
    return t.select(F.lit("targets").alias("file"), "row_id").unionByName(d.select(F.lit("decoys").alias("file"), "row_id"))


def discovery_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _round(qv.discovery_curve(qv.tdc(_winners(spark, sf), "score", "target")), "q_value")


def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return comp.entity_counts(_psm(spark, sf), ["peptide"], "target")


def best_feature(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "psms").select((F.col("label") == 1).alias("target"), *FEATURES).where("target is not null")
    return best_features(df, list(FEATURES), "target", 0.05).select("feature", "descending", "passing")


def fold_split(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.col("run_id").cast("decimal(20,0)") * 1_000_003 + F.col("scannr")  # as the SQL's HUGEINT: a bigint overflows from run_id 3475 on
    key = (whole * 2654435761 % 4294967296).cast("bigint")
    return comp.fold_split(_psm(spark, sf), ["run_id", "scannr"], 3, key).select("row_id", F.col("fold").cast("int").alias("fold"))


def calibrate_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = _psm(spark, sf).withColumn("fold", (F.col("run_id") % 2).cast("int"))
    return _round(calibrate(df, "score", "target", "fold", 0.2).select("row_id", "score"), "score")


def linear_score(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by a given model; a missing value counts as the mean."""
    return _round(_t(spark, sf, "psms").select("row_id", _model(0).score().alias("score")), "score")


def _model(k: int) -> LinearModel:
    """A fixed model; those of other k weigh its features in another order."""
    weights = [*WEIGHTS.values()]
    return LinearModel(tuple(WEIGHTS), (2.0, 1.0, 0.5), (1.7, 2.3, 1.1), tuple(weights[k:] + weights[:k]), 0.5, k)


def ensemble_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every record's mean score by all folds' models, which are given."""
    r = brew(_dataset(spark, sf), 0.05, 0.05, ensemble=True, override=True, models=[_model(k) for k in range(3)])
    return _round(r.scored.select("row_id", "score"), "score")


def rollup_files(spark: SparkSession, sf: str) -> DataFrame:
    """Results of several runs, targets and decoys apart as they are written, put together and rolled up to peptides."""
    w = _winners(spark, sf).select("row_id", "run_id", "peptide", "score", "target")
    parts = [d.where(F.col("run_id") % 2 == k) for k in (0, 1) for d in comp.target_decoy_split(w, "target")]
    levels = rollup_results(functools.reduce(DataFrame.unionByName, parts), "psm", peps_algorithm="hist_nnls")
    return _round(functools.reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("level"), "row_id", "score", "q_value") for name, t in levels.items()]), "q_value")


def zscore_features(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "psms").select("row_id", "refactoredxcorr", "absdm").where("refactoredxcorr is not null and absdm is not null")
    return _round(feat.zscore(df, ["refactoredxcorr", "absdm"]), "refactoredxcorr", "absdm")


def nan_feature_probe(spark: SparkSession, sf: str) -> DataFrame:
    wrong = feat.nan_features(_t(spark, sf, "psms"), list(FEATURES))
    return spark.createDataFrame([(f, f in wrong) for f in FEATURES], "feature string, has_missing boolean")


def role_inference(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "psms").drop("row_id", "run_id")
    r = infer_roles(p.columns, [f.name for f in p.schema.fields if f.dataType.simpleString() in ("int", "bigint", "double")])
    rows = [("id", r.id), ("target", r.target), ("peptide", r.peptide), ("protein", r.protein), *(("spectrum", c) for c in r.spectrum), *(("feature", c) for c in r.features)]
    return spark.createDataFrame(rows, "role string, column_name string")


def label_coercion(spark: SparkSession, sf: str) -> DataFrame:
    return qv.coerce_target(_t(spark, sf, "psms").where("label is not null").select("row_id", "label"), "label")


def composition_key(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", pep_fn.composition_key(F.lower("p_type")).alias("composition"))


def strip_peptides(spark: SparkSession, sf: str) -> DataFrame:
    return pep_fn.strip_peptides(_t(spark, sf, "psms").select("row_id", "peptide"), "peptide").select("row_id", "stripped_sequence")


def base_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "psms").select("row_id", pep_fn.base_sequence(F.col("peptide")).alias("base"))


def digest_kr(spark: SparkSession, sf: str) -> DataFrame:
    """Peptides of the spectra's sequences strung together by run, cut behind K and R, up to two sites missed."""
    return pep_fn.digest_sql(_sequences(spark, sf), "row_id", "sequence", 2, 4, 40).select("row_id", "peptide")


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "psms").where("peptide is not null").select("row_id", pep_fn.bare_peptide(F.col("peptide")).alias("sequence"))


def digest_trypsin(spark: SparkSession, sf: str) -> DataFrame:
    return pep_fn.digest(_sequences(spark, sf), "row_id", "sequence", missed_cleavages=1, min_length=4)


def decoy_proteins(spark: SparkSession, sf: str) -> DataFrame:
    return pep_fn.decoys(_sequences(spark, sf).withColumn("row_id", F.col("row_id").cast("string")), "row_id", "sequence", reverse=True)


def fasta_export(spark: SparkSession, sf: str) -> DataFrame:
    return fasta_lines(_sequences(spark, sf).withColumn("protein", F.col("row_id").cast("string")))


def decoy_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of odd orders matched to those of even ones whose keys have the same digits."""
    p = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("peptide"), (F.col("o_orderkey") % 2 == 0).alias("target"))
    return prot.match_decoys(p.where("not target"), p.where("target"), seed=None)


def flashlfq_export(spark: SparkSession, sf: str) -> DataFrame:
    runs = _t(spark, sf, "msms_runs").select("run_id", F.concat(F.lit("/data/"), "base_name", F.coalesce("raw_data", F.lit(""))).alias("file"))
    psm = _winners(spark, sf).join(runs, "run_id").withColumn("rt", F.col("scannr") / 100.0).withColumn("charge", F.lit(2))
    roles = ColumnRoles(tuple(psm.columns), "target", "peptide", ("run_id", "scannr"), (), "row_id", "proteins", filename="file", scan="scannr", calcmass="calcmass", rt="rt", charge="charge")
    accepted = qv.tdc(comp.best_per_group(psm, ["peptide"], "score", "target", ["row_id"]), "score", "target").where("target")
    return to_flashlfq(psm, accepted, roles, 0.05)


def open_mod_bins(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "psms").where("expmass is not null and calcmass is not null").select("row_id", F.round((F.col("expmass") - F.col("calcmass")) + 0.005, 4).alias("delta"))
    return df.select("row_id", feat.open_modification_bin(F.col("delta"), -10.0, 0.25).alias("center"))


def mz_error(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "psms").where("expmass is not null and calcmass is not null")
    return _round(df.select("row_id", feat.mz_error(F.col("expmass"), F.col("calcmass"), F.lit(2)).alias("error")), "error")


def one_hot_charge(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "psms").select("row_id", (F.col("charge1") + 2 * F.col("charge2") + 3 * F.col("charge3") + 4 * F.col("charge4") + 5 * F.col("charge5")).alias("charge"))
    return feat.one_hot(df, "charge", "charge_", [1, 2, 3, 4, 5]).drop("charge")


def log_transform(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").cast("double").alias("wide"))
    return _round(feat.auto_log(df, ["wide"]), "wide")


def safe_division(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "psms")
    return _round(df.select("row_id", feat.safe_divide(F.col("sp"), F.col("enzint"), 0.0).alias("ratio")), "ratio")


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pin_files").select("file_id", pep_fn.basename(F.concat(F.lit("/a/b/"), "file_name")).alias("name"))


def pi0_slope(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pep_ops.pi0_slope(_psm(spark, sf), "score", "target"), "pi0")


def pep_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pep_ops.peps(_winners(spark, sf), "score", "target", "hist_nnls").select("row_id", "pep"), "pep")


def pep_kde(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pep_ops.peps(_winners(spark, sf), "score", "target", "kde_nnls").select("row_id", "pep"), "pep")


def pep_qvality(spark: SparkSession, sf: str) -> DataFrame:
    return pep_ops.peps(_winners(spark, sf), "score", "target", "qvality").select("row_id", "pep")


def _dataset(spark: SparkSession, sf: str) -> PsmDataset:
    df = _t(spark, sf, "psms").where("peptide is not null").na.fill(0.0, list(FEATURES)).select("row_id", "run_id", "label", "scannr", "peptide", "proteins", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])
    roles = ColumnRoles(tuple(df.columns), "label", "peptide", ("run_id", "scannr"), FEATURES, "row_id", "proteins")
    return PsmDataset.of(df, roles, row_id="row_id", drop_na_features=False)


def brew_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by cross-validated models: ten iterations, class weights by grid search."""
    return brew(_dataset(spark, sf), 0.05, 0.05).scored.select("row_id", "fold", "score")


def end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """From records to confident peptides: re-scoring, competition, rollup, q-values, error probabilities."""
    ds = _dataset(spark, sf)
    scored = brew(ds, 0.05, 0.05).scored
    return assign_confidence(PsmDataset(scored, ds.roles), "score", 0.05).peptides.select("row_id", "peptide", "score", "q_value", "pep")


QUERIES = {
    f.__name__: f
    for f in (
        tdc_qvalues, tdc_qvalues_asc, qvalues_from_counts, qvalues_from_peps, qvalues_from_peps_all, qvalues_hist, streaming_confidence, stream_event_histogram, td_histogram, score_statistics, bin_edges,
        update_labels, training_set, psm_competition, no_dedup, rollup_multi_level, peptide_confidence, target_decoy_split, discovery_curve, entity_counts, best_feature, fold_split,
        calibrate_scores, linear_score, ensemble_score, rollup_files, zscore_features, nan_feature_probe, role_inference, label_coercion, composition_key, strip_peptides, base_sequence, digest_kr, digest_trypsin,
        decoy_proteins, fasta_export, decoy_matching, flashlfq_export,
        open_mod_bins, mz_error, one_hot_charge, log_transform, safe_division, file_names, pi0_slope, pep_hist, pep_kde, pep_qvality, brew_scores, end_to_end,
    )
}

_BARE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(peptide, '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g'), '^.*?\.', ''), '\..*?$', '')"""
_LABELS = f"WITH {tdc_sql(PSM_SQL)} SELECT row_id, (CASE WHEN NOT target THEN -1 WHEN q <= 0.05 THEN 1 ELSE 0 END)::INTEGER AS label FROM src JOIN q ON score::FLOAT = s"  # noqa: S608
_GRID = f"r AS (SELECT min(score) AS lo, max(score) AS hi FROM src), b AS (SELECT least(floor((score - lo) / ((hi - lo) / {BINS})), {BINS - 1})::INTEGER AS bin, count(*) FILTER (target) AS targets, count(*) FILTER (NOT target) AS decoys FROM src, r GROUP BY 1)"  # noqa: S608
_BEST = " UNION ALL ".join(
    f"SELECT {i} AS i, {d} AS falling, target, {'' if d else '-'}{f}::DOUBLE AS v FROM rows WHERE {f} IS NOT NULL" for i, f in enumerate(FEATURES) for d in (1, 0)
)  # noqa: S608

def _linear_sql(k: int, filled: bool = False) -> str:
    """The score of _model(k); a missing value counts as the mean, or as 0 where the data are filled."""
    m = _model(k)
    return "0.5::DOUBLE" + "".join(f" + coalesce(({f'coalesce({f}, 0)' if filled else f} - {mean}::DOUBLE) / {sd}::DOUBLE, 0) * {w}::DOUBLE" for f, mean, sd, w in zip(m.features, m.mean, m.sd, m.weights))


def _hist_sql(bins: str) -> str:
    """CTEs r(lo, hi, k, width) and e(i, t, d), a histogram of src with a number of bins that may depend on n, lo, hi and sd."""
    return f"""r0 AS (SELECT count(*) AS n, min(score) AS lo, max(score) AS hi, stddev_samp(score) AS sd FROM src), r AS (SELECT lo, hi, ({bins})::INTEGER AS k, (hi - lo) / ({bins}) AS width FROM r0),
    h AS (SELECT least(floor((score - lo) / width), k - 1)::INTEGER AS i, count(*) FILTER (target) AS t, count(*) FILTER (NOT target) AS d FROM src, r GROUP BY 1),
    e AS (SELECT x.i::INTEGER AS i, coalesce(t, 0) AS t, coalesce(d, 0) AS d FROM (SELECT unnest(range(k)) AS i FROM r) x LEFT JOIN h ON h.i = x.i)"""  # noqa: S608


# z(i, w, y) to the falling fit iso(i, y): the least of the greatest means of runs around i. Then p(row_id, pep) by interpolation between bin centres.
_FALLING = """u AS (SELECT i, sum(w) OVER o AS cw, sum(w * y) OVER o AS cy, w, y FROM z WINDOW o AS (ORDER BY i ROWS UNBOUNDED PRECEDING)),
    runs AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.w * a.y) / (b.cw - a.cw + a.w) AS mean FROM u a JOIN u b ON b.i >= a.i),
    top AS (SELECT a, b, max(mean) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS y FROM runs), iso AS (SELECT b AS i, min(y) AS y FROM top GROUP BY 1)"""
_LOOKUP = """pl AS (SELECT row_id, least(greatest((score - (lo + width / 2)) / width, 0), k - 1) AS x, k FROM src, r), fl AS (SELECT row_id, x, least(floor(x), greatest(k - 2, 0))::INTEGER AS j, k FROM pl),
    p AS (SELECT row_id, round(a.y + (b.y - a.y) * (x - j), 6) AS pep FROM fl JOIN iso a ON a.i = j JOIN iso b ON b.i = least(j + 1, k - 1))"""
# Bins without targets lie on the line between their neighbours, and on the one to 0 behind the last.
_HIST_PEP = f"""z AS (SELECT i, t AS w, d / t::DOUBLE AS y FROM e WHERE t > 0), {_FALLING.replace('iso AS', 'full_bins AS')}, known AS (SELECT i, y FROM full_bins UNION ALL SELECT k, 0 FROM r),
    near AS (SELECT e.i, (SELECT max(i) FROM known q WHERE q.i <= e.i) AS l, (SELECT min(i) FROM known q WHERE q.i >= e.i) AS h FROM e),
    iso AS (SELECT near.i, greatest(0, least(1, CASE WHEN l IS NULL OR l = h THEN b.y ELSE a.y + (b.y - a.y) * (near.i - l) / (h - l)::DOUBLE END)) AS y FROM near JOIN known b ON b.i = h LEFT JOIN known a ON a.i = l), {_LOOKUP}"""
_TRYPTIC = f"string_split(regexp_replace(regexp_replace(trim({_BARE}, '-'), '([KR])([^P])', '\\1|\\2', 'g'), '([KR])([^P|])', '\\1|\\2', 'g'), '|')"

ORACLES = {
    "tdc_qvalues": f"WITH {tdc_sql(PSM_SQL)} SELECT row_id, round(q, 6) AS q_value FROM src JOIN q ON score::FLOAT = s",
    "tdc_qvalues_asc": f"WITH {tdc_sql(PSM_SQL + ' AND absdm IS NOT NULL', 'absdm', False)} SELECT row_id, round(q, 6) AS q_value FROM src JOIN q ON absdm::FLOAT = s",
    "qvalues_from_counts": f"""WITH src AS ({PSM_SQL}), g AS (SELECT score AS s, count(*) FILTER (target) AS t, count(*) FILTER (NOT target) AS d FROM src GROUP BY 1),
        c AS (SELECT s, sum(t) OVER w AS ct, sum(d) OVER w AS cd FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT s, least(1.0::DOUBLE, min((cd + 1) / greatest(ct, 1)::DOUBLE) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING)) AS q FROM c)
        SELECT row_id, round(q, 6) AS q_value FROM src JOIN m ON score = s""",
    "qvalues_from_peps": f"""WITH src AS (SELECT *, 1 / (1 + exp(score - 2)) AS pep FROM ({PSM_SQL}) WHERE target), g AS (SELECT score AS s, sum(pep) AS p, count(*) AS n FROM src GROUP BY 1),
        c AS (SELECT s, sum(p) OVER w / sum(n) OVER w AS f FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT s, min(f) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS q FROM c) SELECT row_id, round(q, 6) AS q_value FROM src JOIN m ON score = s""",
    "qvalues_from_peps_all": f"""WITH src AS (SELECT *, score::DOUBLE AS x, 1 / (1 + exp(score - 2)) AS pep FROM ({PSM_SQL})), g AS (SELECT x, sum(pep) FILTER (target) AS p, count(*) FILTER (target) AS n FROM src GROUP BY 1),
        c AS (SELECT x, n, sum(p) OVER w / sum(n) OVER w AS f FROM g WINDOW w AS (ORDER BY x DESC ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT x, CASE WHEN n > 0 THEN x END AS k, CASE WHEN n > 0 THEN min(CASE WHEN n > 0 THEN f END) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) END AS q FROM c),
        i AS (SELECT x, last_value(k IGNORE NULLS) OVER lo AS xl, last_value(q IGNORE NULLS) OVER lo AS ql, last_value(k IGNORE NULLS) OVER hi AS xh, last_value(q IGNORE NULLS) OVER hi AS qh FROM m
            WINDOW lo AS (ORDER BY x ROWS UNBOUNDED PRECEDING), hi AS (ORDER BY x DESC ROWS UNBOUNDED PRECEDING))
        SELECT row_id, round(CASE WHEN xl IS NULL THEN qh WHEN xh IS NULL OR xh = xl THEN ql ELSE ql + (qh - ql) * ((x - xl) / (xh - xl)) END, 6) AS q_value FROM src JOIN i USING (x)""",
    "qvalues_hist": f"""WITH src AS ({PSM_SQL}), {_GRID}, e AS (SELECT i AS bin, coalesce(targets, 0) AS t, coalesce(decoys, 0) AS d FROM range({BINS}) x(i) LEFT JOIN b ON b.bin = i),
        c AS (SELECT bin, sum(t) OVER w AS ct, sum(d) OVER w AS cd FROM e WINDOW w AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT bin, min(least(1.0::DOUBLE, (cd + 1) / greatest(ct, 1)::DOUBLE)) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS q FROM c),
        v AS (SELECT bin, q FROM m UNION ALL SELECT {BINS}, 0.0),
        p AS (SELECT row_id, (score - lo) / ((hi - lo) / {BINS}) AS x FROM src, r), k AS (SELECT row_id, x, least(floor(x), {BINS - 1})::INTEGER AS k FROM p)
        SELECT row_id, round(a.q + (z.q - a.q) * (x - k), 6) AS q_value FROM k JOIN v a ON a.bin = k JOIN v z ON z.bin = k + 1""",
    "stream_event_histogram": """WITH r AS (SELECT 0.0 AS lo, 1000.0 AS hi) SELECT least(floor(greatest(least(value, hi), lo) / 10.0), 99)::INTEGER AS bin, count(*) FILTER (event_type = 'purchase')::BIGINT AS targets,
        count(*) FILTER (event_type <> 'purchase')::BIGINT AS decoys FROM events, r WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1""",
    "td_histogram": f"WITH src AS ({PSM_SQL}), {_GRID} SELECT bin, targets::BIGINT AS targets, decoys::BIGINT AS decoys FROM b",
    "score_statistics": f"SELECT count(*)::BIGINT AS n, min(score) AS min, max(score) AS max, round(sum(score), 6) AS sum, round(avg(score), 6) AS mean, round(var_samp(score), 6) AS var, round(stddev_samp(score), 6) AS sd FROM ({PSM_SQL})",
    "bin_edges": f"""WITH s AS (SELECT count(*) AS n, max(score) - min(score) AS span, stddev_samp(score) AS sd FROM ({PSM_SQL}))
        SELECT 'sturges' AS rule, ceil(span / (span / (log2(n) + 1)))::INTEGER AS bins FROM s UNION ALL SELECT 'terrell_scott', ceil(span / (span / ceil((2 * n) ** (1.0 / 3))))::INTEGER FROM s
        UNION ALL SELECT 'scott', ceil(span / ((24 * sqrt(pi())) ** (1.0 / 3) * sd * n::DOUBLE ** (-1.0 / 3)))::INTEGER FROM s""",
    "update_labels": _LABELS,
    "training_set": f"SELECT row_id, ((label + 1) // 2)::INTEGER AS y FROM ({_LABELS}) WHERE label <> 0",
    "psm_competition": f"SELECT row_id, run_id, scannr, score, target FROM ({WINNERS_SQL})",
    "no_dedup": f"SELECT row_id, score, target FROM ({PSM_SQL})",
    "rollup_multi_level": f"""WITH w AS (SELECT *, {_BARE} AS bare FROM ({WINNERS_SQL})), e AS (
        SELECT 'peptide' AS level, peptide AS k, * FROM w UNION ALL SELECT 'sequence', bare, * FROM w UNION ALL SELECT 'run_sequence', run_id || '|' || bare, * FROM w)
        SELECT level, row_id, score, target FROM (SELECT *, row_number() OVER (PARTITION BY level, k ORDER BY score DESC, target ASC, row_id) AS rn FROM e) WHERE rn = 1""",
    "peptide_confidence": f"""WITH {tdc_sql(f'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY score DESC, target ASC, row_id) AS rk FROM ({WINNERS_SQL})) WHERE rk = 1')}
        SELECT row_id, peptide, score, target, round(q, 6) AS q_value FROM src JOIN q ON score::FLOAT = s""",
    "target_decoy_split": f"SELECT CASE WHEN target THEN 'targets' ELSE 'decoys' END AS file, row_id FROM ({WINNERS_SQL})",
    "discovery_curve": f"WITH {tdc_sql(WINNERS_SQL)} SELECT round(q, 6) AS q_value, (sum(n) OVER (ORDER BY q))::BIGINT AS discoveries FROM (SELECT q, sum(t) AS n FROM q GROUP BY 1) WHERE n > 0",
    "entity_counts": f"SELECT count(*) FILTER (target)::BIGINT AS targets, count(*) FILTER (NOT target)::BIGINT AS decoys, count(*)::BIGINT AS rows, count(DISTINCT peptide)::BIGINT AS entities FROM ({PSM_SQL})",
    "best_feature": f"""WITH rows AS (SELECT label = 1 AS target, * FROM psms WHERE label IS NOT NULL), {tdc_sql(_BEST, 'v', True, 'i, falling')},
        n AS (SELECT i, falling, coalesce(sum(t) FILTER (q <= 0.05), 0) AS passing FROM q GROUP BY i, falling)
        SELECT ({list(FEATURES)})[i + 1] AS feature, falling = 1 AS descending, passing::BIGINT AS passing FROM n ORDER BY passing DESC, i, falling DESC LIMIT 1""",
    "fold_split": f"""WITH src AS (SELECT row_id, (run_id * 1000003 + scannr)::HUGEINT * 2654435761 % 4294967296 AS h FROM ({PSM_SQL})), g AS (SELECT h, count(*) AS n FROM src GROUP BY 1),
        c AS (SELECT h, sum(n) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) - n AS st, sum(n) OVER () AS total FROM g)
        SELECT row_id, ((st >= total // 3 + least(total % 3, 1))::INTEGER + (st >= 2 * (total // 3) + least(total % 3, 2))::INTEGER) AS fold FROM src JOIN c USING (h)""",
    "calibrate_scores": f"""WITH {tdc_sql(f'SELECT *, run_id % 2 AS fold FROM ({PSM_SQL})', parts='fold')}, j AS (SELECT src.*, q FROM src JOIN q ON src.fold = q.fold AND score::FLOAT = s),
        k AS (SELECT fold, min(score) FILTER (target AND q <= 0.2) AS t, median(score) FILTER (NOT target) AS m FROM j GROUP BY 1) SELECT row_id, round((score - t) / (t - m), 6) AS score FROM j JOIN k USING (fold)""",
    "linear_score": f"SELECT row_id, round({_linear_sql(0)}, 6) AS score FROM psms",
    "ensemble_score": f"SELECT row_id, round(({_linear_sql(0, True)} + {_linear_sql(1, True)} + {_linear_sql(2, True)}) / 3, 6) AS score FROM psms WHERE peptide IS NOT NULL",
    "rollup_files": f"""WITH w AS ({WINNERS_SQL}), e AS (SELECT 'psm' AS level, row_id::VARCHAR AS k, * FROM w UNION ALL SELECT 'peptide', peptide, * FROM w), {tdc_sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, k ORDER BY score DESC, target ASC, row_id) AS rk FROM e) WHERE rk = 1", parts="level")}
        SELECT src.level, row_id, score, round(q, 6) AS q_value FROM src JOIN q ON src.level = q.level AND score::FLOAT = s""",
    "streaming_confidence": f"""WITH src AS ({PSM_SQL}), {_hist_sql("least(greatest(ceil((hi - lo) / ((24 * sqrt(pi())) ** (1.0 / 3) * sd * n::DOUBLE ** (-1.0 / 3))), 50), 500)")}, {_HIST_PEP},
        c AS (SELECT i, sum(t) OVER w AS ct, sum(d) OVER w AS cd FROM e WINDOW w AS (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT i, min(least(1.0::DOUBLE, (cd + 1) / greatest(ct, 1)::DOUBLE)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS q FROM c),
        v AS (SELECT i, q FROM m UNION ALL SELECT k, 0.0 FROM r), x AS (SELECT row_id, (score - lo) / width AS x, k FROM src, r), y AS (SELECT row_id, x, least(floor(x), k - 1)::INTEGER AS i FROM x)
        SELECT row_id, round(a.q + (z.q - a.q) * (x - y.i), 6) AS q_value, pep FROM y JOIN v a ON a.i = y.i JOIN v z ON z.i = y.i + 1 JOIN p USING (row_id)""",
    "pep_hist": f"""WITH src AS ({WINNERS_SQL}), {_hist_sql("ceil((hi - lo) / ((24 * sqrt(pi())) ** (1.0 / 3) * sd * n::DOUBLE ** (-1.0 / 3)))")}, {_HIST_PEP} SELECT row_id, pep FROM p""",
    "pep_kde": f"""WITH src AS ({WINNERS_SQL}), {_hist_sql("500")}, g AS (SELECT i, lo + (i + 0.5) * width AS c, t, d, width FROM e, r),
        o AS (SELECT sum(t) AS tn, sum(d) AS dn, sum(t * c) / sum(t) AS tm, sum(d * c) / sum(d) AS dm FROM g),
        b AS (SELECT greatest(sqrt(sum(t * (c - tm) ** 2) / (any_value(tn) - 1)) * any_value(tn) ** (-0.2), any_value(width) / 2) AS tb, greatest(sqrt(sum(d * (c - dm) ** 2) / (any_value(dn) - 1)) * any_value(dn) ** (-0.2), any_value(width) / 2) AS db FROM g, o),
        f AS (SELECT x.i, sum(exp(-0.5 * ((x.c - y.c) / tb) ** 2) * y.t) / any_value(tn * tb * sqrt(2 * pi())) AS pt, sum(exp(-0.5 * ((x.c - y.c) / db) ** 2) * y.d) / any_value(dn * db * sqrt(2 * pi())) AS pd FROM g x, g y, o, b GROUP BY 1),
        z AS (SELECT i, greatest(pt, 1e-300) AS w, CASE WHEN pt > 0 THEN greatest(0, least(1, 1 - greatest(0, pt - dn / tn * pd) / pt)) ELSE 1 END AS y FROM f, o), {_FALLING}, {_LOOKUP} SELECT row_id, pep FROM p""",
    "role_inference": """WITH c AS (SELECT column_name AS n, column_type AS t FROM (DESCRIBE SELECT * EXCLUDE (row_id, run_id) FROM psms)), r AS (SELECT n, CASE WHEN n IN ('scannr', 'expmass') THEN 'spectrum' WHEN n IN ('specid', 'label', 'peptide', 'proteins', 'calcmass') THEN NULL
        WHEN t IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'feature' END AS role FROM c) SELECT role, n AS column_name FROM r WHERE role IS NOT NULL UNION ALL SELECT * FROM (VALUES ('id', 'specid'), ('target', 'label'), ('peptide', 'peptide'), ('protein', 'proteins'))""",
    "decoy_proteins": f"""WITH s AS (SELECT row_id, {_TRYPTIC} AS p FROM psms WHERE peptide IS NOT NULL)
        SELECT 'decoy_' || row_id AS row_id, array_to_string(list_transform(p, lambda x: CASE WHEN length(x) > 2 THEN x[1] || reverse(x[2:-2]) || x[-1] ELSE x END), '') AS sequence FROM s""",
    "digest_trypsin": f"""WITH s AS (SELECT row_id, {_TRYPTIC} AS p FROM psms WHERE peptide IS NOT NULL), i AS (SELECT row_id, p, unnest(range(1, len(p) + 1)) AS i FROM s),
        w AS (SELECT row_id, unnest([p[i], CASE WHEN i < len(p) THEN p[i] || p[i + 1] END]) AS peptide FROM i) SELECT DISTINCT row_id, peptide FROM w WHERE length(peptide) BETWEEN 4 AND 50""",
    "zscore_features": """WITH p AS (SELECT row_id, refactoredxcorr AS a, absdm AS b FROM psms WHERE refactoredxcorr IS NOT NULL AND absdm IS NOT NULL), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM p)
        SELECT row_id, round((a - ma) / sa, 6) AS refactoredxcorr, round((b - mb) / sb, 6) AS absdm FROM p, s""",
    "nan_feature_probe": " UNION ALL ".join(f"SELECT '{f}' AS feature, coalesce(bool_or({f} IS NULL OR isnan({f}::DOUBLE)), false) AS has_missing FROM psms" for f in FEATURES),
    "label_coercion": "SELECT row_id, label = 1 AS label FROM psms WHERE label IS NOT NULL",
    "composition_key": "SELECT p_partkey, array_to_string(list_sort(string_split(lower(p_type), '')), '') AS composition FROM part",
    "strip_peptides": f"WITH b AS (SELECT row_id, trim({_BARE}, '-') AS s FROM psms), l AS (SELECT bool_and(s = lower(s)) AS low FROM b) SELECT row_id, CASE WHEN low THEN upper(s) ELSE regexp_replace(s, '[a-z]', '', 'g') END AS stripped_sequence FROM b, l",
    "base_sequence": f"SELECT row_id, {_BARE} AS base FROM psms",
    "digest_kr": f"""WITH s AS (SELECT row_id, list_filter(string_split(regexp_replace(trim({_BARE}, '-'), '([KR])', '\\1|', 'g'), '|'), lambda p: p <> '') AS p FROM psms WHERE peptide IS NOT NULL),
        i AS (SELECT row_id, p, unnest(range(1, len(p) + 1)) AS i FROM s), w AS (SELECT row_id, unnest([CASE WHEN i + n <= len(p) THEN array_to_string(p[i:i + n], '') END FOR n IN [0, 1, 2]]) AS peptide FROM i)
        SELECT DISTINCT row_id, peptide FROM w WHERE length(peptide) BETWEEN 4 AND 40""",
    "fasta_export": f"SELECT '>' || row_id || chr(10) || trim({_BARE}, '-') AS value FROM psms WHERE peptide IS NOT NULL",
    "decoy_matching": """WITH p AS (SELECT DISTINCT o_orderkey % 2 = 0 AS target, o_custkey::VARCHAR AS peptide FROM orders), r AS (SELECT target, peptide, array_to_string(list_sort(string_split(peptide, '')), '') AS k FROM p),
        n AS (SELECT *, row_number() OVER (PARTITION BY target, k ORDER BY peptide) AS rn FROM r) SELECT d.peptide AS decoy, t.peptide AS target FROM n d JOIN n t ON d.k = t.k AND d.rn = t.rn AND NOT d.target AND t.target""",
    "flashlfq_export": f"""WITH w AS ({WINNERS_SQL}), {tdc_sql('SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY peptide ORDER BY score DESC, target ASC, row_id) AS rk FROM w) WHERE rk = 1')}
        SELECT base_name || coalesce(raw_data, '') AS "File Name", {_BARE} AS "Base Sequence", peptide AS "Full Sequence", calcmass AS "Peptide Monoisotopic Mass", scannr / 100.0::DOUBLE AS "Scan Retention Time",
        2::INTEGER AS "Precursor Charge", replace(proteins, chr(9), '; ') AS "Protein Accession" FROM src JOIN q ON score::FLOAT = s JOIN msms_runs USING (run_id) WHERE target AND q <= 0.05 AND proteins IS NOT NULL""",
    "open_mod_bins": "SELECT row_id, round(-10.0::DOUBLE + (floor((round((expmass - calcmass) + 0.005::DOUBLE, 4) + 10.0::DOUBLE) / 0.25::DOUBLE) + 0.5::DOUBLE) * 0.25::DOUBLE, 4) AS center FROM psms WHERE expmass IS NOT NULL AND calcmass IS NOT NULL",
    "mz_error": "SELECT row_id, round(abs((expmass / 2 + 1.00727646677::DOUBLE) - (calcmass / 2 + 1.00727646677::DOUBLE)), 6) AS error FROM psms WHERE expmass IS NOT NULL AND calcmass IS NOT NULL",
    "one_hot_charge": "SELECT row_id, " + ", ".join(f"coalesce((charge1 + 2 * charge2 + 3 * charge3 + 4 * charge4 + 5 * charge5 = {k})::INTEGER, 0) AS charge_{k}" for k in range(1, 6)) + " FROM psms",
    "log_transform": "WITH s AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, min(o_orderkey) FILTER (o_orderkey > 0) AS pos FROM orders) SELECT o_orderkey, o_totalprice, round(CASE WHEN lo >= 0 AND hi / pos::DOUBLE >= 10000 THEN CASE WHEN o_orderkey > 0 THEN log10(o_orderkey) ELSE log10(pos) - 1 END ELSE o_orderkey END, 6)::DOUBLE AS wide FROM orders, s",
    "safe_division": "SELECT row_id, round(coalesce(CASE WHEN enzint <> 0 THEN sp / enzint END, 0), 6)::DOUBLE AS ratio FROM psms",
    "file_names": "SELECT file_id, file_name AS name FROM pin_files",
    "pi0_slope": f"""WITH src AS ({PSM_SQL}), r AS (SELECT min(score) AS lo, max(score) AS hi FROM src), b AS (SELECT least(floor((score - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) FILTER (target) AS t, count(*) FILTER (NOT target) AS d FROM src, r GROUP BY 1),
        e AS (SELECT i AS bin, coalesce(t, 0) AS t, coalesce(d, 0) AS d FROM range(50) x(i) LEFT JOIN b ON b.bin = i), k AS (SELECT min(bin) AS last FROM e WHERE d >= 0.9 * (SELECT max(d) FROM e))
        SELECT round(greatest(regr_slope(t, d), 1e-10), 6) AS pi0 FROM e, k WHERE bin < last""",
}
