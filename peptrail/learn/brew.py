"""Semi-supervised re-scoring by group-aware cross-validation.

Rows of one spectrum share a fold. For each fold a model learns from the others: accepted targets against decoys, starting from the best
single feature, rescored and relabelled a number of times. A q-value falls with the score, so a label is a comparison with a threshold:
no iteration joins or moves rows. It aggregates counts by score for the thresholds and small matrices for the weights, over one
persisted table of features, for all folds at once.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import logging
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from peptrail.dataset import ROW_ID, PsmDataset
from peptrail.learn.blocks import Block, Blocks, add_up, pack
from peptrail.learn.estimators import Estimator, train_fold
from peptrail.learn.svm import Problem, margin_terms, newton
from peptrail.learn.thresholds import Question, accepted, medians
from peptrail.operators.competition import fold_split, training_sample

log = logging.getLogger(__name__)
GRID = tuple((p, n) for p in (0.1, 1.0, 10.0) for n in (0.1, 1.0, 10.0))
CV_PARTS = 3


def _standard(x: Column, mean: float, sd: float) -> Column:
    return F.coalesce(F.nanvl((x - mean) / sd, F.lit(0.0)), F.lit(0.0))


@dataclass(frozen=True)
class LinearModel:
    """Standardise (mean, sd), multiply, add: a score is a pure column expression. A missing value counts as the mean."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    fold: int = 0

    def score(self) -> Column:
        terms = [_standard(F.col(f"`{f}`").cast("double"), m, s) * w for f, m, s, w in zip(self.features, self.mean, self.sd, self.weights) if w]
        return sum(terms, F.lit(self.bias))

    def report(self) -> list[tuple[str, float]]:
        """(feature, weight) and the bias."""
        return [*zip(self.features, self.weights), ("bias", self.bias)]


def save_models(models: list[LinearModel], path: str) -> None:
    with open(path, "w") as f:
        json.dump([asdict(m) for m in models], f)


def load_models(path: str) -> list[LinearModel]:
    """Models saved as JSON, or one from a table of weights (tab-separated: a line of names with m0 for the bias, normalised, then raw weights)."""
    with open(path) as f:
        text = f.read()
    if text.lstrip().startswith("["):
        return [LinearModel(**{k: tuple(v) if isinstance(v, list) else v for k, v in m.items()}) for m in json.loads(text)]
    rows = [line.split("\t") for line in text.splitlines() if line.strip() and not line.startswith("#")]
    names, raw = rows[0], [float(v) for v in rows[2]]
    bias = raw[names.index("m0")] if "m0" in names else 0.0
    feats = [(n, w) for n, w in zip(names, raw) if n != "m0"]
    return [LinearModel(tuple(n for n, _ in feats), (0.0,) * len(feats), (1.0,) * len(feats), tuple(w for _, w in feats), bias)]


def _race(rows: Blocks, features: list[int], fdr: float, folds: int = 1, without: list[int | None] | None = None) -> dict[int | None, dict]:
    """For each fold left out (None: no fold) the feature that accepts most targets of the rest: feature, descending, passing, threshold.

    Earlier features and falling order win ties. Every feature's values are counted once, whatever the number of folds and directions.
    """
    asked = [(k, i, down) for k in without or [None] for i in features for down in (True, False)]
    found = accepted(rows, lambda b: [b.x[:, i] for i in range(b.x.shape[1])], [Question(i, down, k, ("fold", k)) for k, i, down in asked], fdr, folds)
    best: dict[int | None, dict] = {}
    for (k, i, down), a in zip(asked, found):
        if k not in best or a.passing > best[k]["passing"]:
            best[k] = {"feature": i, "descending": down, "passing": a.passing, "threshold": a.threshold}
    return best


def best_features(df: DataFrame, features: list[str], target: str, fdr: float) -> DataFrame:
    """(feature, descending, passing, threshold): the single feature that accepts most targets, over both directions; one row.

    threshold: the worst accepted value, negated if lower is better; null if none is accepted. Nulls and NaN don't count. Earlier features
    and falling order win ties.
    """
    rows = pack(df, [F.col(f"`{f}`") for f in features], F.col(target))
    try:
        r = _race(rows, list(range(len(features))), fdr)[None]
    finally:
        rows.close()
    return df.sparkSession.createDataFrame([(features[r["feature"]], r["descending"], r["passing"], r["threshold"])], "feature string, descending boolean, passing long, threshold double")


@dataclass
class BrewResult:
    """scored: the data with ``score`` (higher is better) and ``fold``; models by fold; what was chosen, and accepted counts."""

    scored: DataFrame
    models: list[LinearModel]
    used: str
    feature: str
    feature_passing: int
    model_passing: int


def brew(
    dataset: PsmDataset, train_fdr: float = 0.01, test_fdr: float = 0.01, folds: int = 3, max_iter: int = 10, seed: int = 1, direction: str | None = None,
    override: bool = False, subset_max_train: int | None = None, ensemble: bool = False, search: bool = True, models: list[LinearModel] | None = None,
    start_model: LinearModel | None = None, estimator: Estimator | None = None,
) -> BrewResult:
    """Scores by models that never saw the rows they score.

    ``direction``: the feature to start from; ``override``: keep models that accept no more than the best feature; ``models``: trained
    before, one a fold, used as they are; ``start_model``: one to start from, which stays in use for a fold whose training accepts fewer;
    ``estimator``: another kind of model (see estimators), fitted fold by fold. If a fold's model fails, or the models accept fewer targets than the best single feature, that
    feature is the score (negated if lower is better). RuntimeError if no feature accepts any target.
    """
    roles = dataset.roles
    feats, y = list(roles.features), roles.target
    if not feats:
        raise ValueError("the dataset has no features")
    df = fold_split(dataset.df, list(roles.spectrum), folds).persist(StorageLevel.MEMORY_AND_DISK)
    ks = list(range(folds))
    part = F.abs(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in roles.spectrum]) % CV_PARTS)
    chosen = df if subset_max_train is None else training_sample(df, ["fold"], ROW_ID, max(1, subset_max_train // max(1, folds - 1)), seed)
    rows = pack(chosen, [F.col(f"`{f}`") for f in feats], F.col(f"`{y}`"), F.col("fold"), part)
    try:
        if direction is not None and direction not in feats:
            raise ValueError(f"no feature {direction}")
        best = _race(rows, list(range(len(feats))), train_fdr, folds, ks)
        overall = max(best.values(), key=lambda r: r["passing"])
        feature = feats[overall["feature"]]
        if overall["passing"] == 0 and models is None:
            raise RuntimeError("no feature accepts any target at this rate")
        trained: dict[int, LinearModel | None] = {}
        if models is not None:
            if len(models) not in (1, folds):
                raise ValueError("as many models as folds are needed")
            trained = {k: models[k % len(models)] for k in ks}
        elif estimator is not None:
            return _brew_estimator(estimator, df, chosen, best, overall, feats, y, train_fdr, test_fdr, max_iter, override, ensemble, ks)
        else:
            trained = _train(rows, best, feats, train_fdr, max_iter, direction, override, search, ks, start_model)
        whole = [m for m in trained.values() if m is not None]
        scored, passing = None, -1
        if len(whole) == folds:
            raw = {k: trained[k].score() for k in ks}
            if ensemble:
                scored = df.withColumn("score", sum(raw.values(), F.lit(0.0)) / folds)
            else:
                picked = F.lit(None).cast("double")
                for k in ks:
                    picked = F.when(F.col("fold") == k, raw[k]).otherwise(picked)
                scored = calibrate(df.withColumn("score", picked), "score", y, "fold", test_fdr, ks)
            passing = _passing(scored, y, test_fdr)
        if scored is None or (overall["passing"] > passing and not override):
            value = F.col(f"`{feature}`").cast("double")
            scored = df.withColumn("score", value if overall["descending"] else -value)
            return BrewResult(scored, whole, "feature", feature, overall["passing"], passing)
        return BrewResult(scored, whole, "model", feature, overall["passing"], passing)
    finally:
        rows.close()


def _passing(scored: DataFrame, target: str, fdr: float) -> int:
    rows = pack(scored, [F.col("score")], F.col(f"`{target}`"))
    try:
        return accepted(rows, lambda b: [b.x[:, 0]], [Question(0)], fdr)[0].passing
    finally:
        rows.close()


def _brew_estimator(estimator, df, rows, best, overall, feats, y, train_fdr, test_fdr, max_iter, override, ensemble, ks) -> BrewResult:  # noqa: ANN001
    """As ``brew``, with a model of any kind: each fold is trained and scored by itself."""
    feature = feats[overall["feature"]]
    names = [f"_x{i}" for i in range(len(feats))]
    columns = [F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(feats, names)]
    train_rows = rows.select(ROW_ID, y, "fold", *columns).persist(StorageLevel.MEMORY_AND_DISK)
    scorers = {}
    for k in ks:
        r = best[k]
        if r["threshold"] is None:
            continue
        scorer, passing = train_fold(train_rows.where(F.col("fold") != k), estimator, names, y, (names[r["feature"]], r["descending"], r["threshold"]), train_fdr, max_iter)
        if scorer is not None and (override or passing > r["passing"]):
            scorers[k] = scorer
    train_rows.unpersist()
    named = df.select("*", *columns)
    passing = -1
    if len(scorers) == len(ks):
        if ensemble:
            for k in ks:
                named = scorers[k].score(named, f"_score{k}")
            scored = named.withColumn("score", sum([F.col(f"_score{k}") for k in ks], F.lit(0.0)) / len(ks)).drop(*[f"_score{k}" for k in ks])
        else:
            parts = [scorers[k].score(named.where(F.col("fold") == k), "score") for k in ks]
            scored = calibrate(functools.reduce(DataFrame.unionByName, parts), "score", y, "fold", test_fdr, ks)
        scored = scored.drop(*names)
        passing = _passing(scored, y, test_fdr)
        if override or overall["passing"] <= passing:
            return BrewResult(scored, [], "model", feature, overall["passing"], passing)
    value = F.col(f"`{feature}`").cast("double")
    return BrewResult(df.withColumn("score", value if overall["descending"] else -value), [], "feature", feature, overall["passing"], passing)


def calibrate(df: DataFrame, score: str, target: str, fold: str, fdr: float, folds: list[int] | None = None) -> DataFrame:
    """Scores of each fold shifted and scaled: the worst accepted target is at 0, the decoys' median at -1.

    (s - t) / (t - m): t the worst accepted target's score, m the exact median of decoys; of a fold without decoys t - 1. ``folds``: the
    folds' numbers, if known. Null scores stay null and don't count. RuntimeError if a fold accepts none; rows without a fold get null.
    """
    if folds is None:
        folds = sorted(r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect())  # one row a fold
    if not folds:
        return df.withColumn(score, F.col(score).cast("double"))
    at = {k: i for i, k in enumerate(folds)}
    number = F.lit(None).cast("int")
    for k, i in at.items():
        number = F.when(F.col(fold) == k, i).otherwise(number)
    rows = pack(df.where(F.col(fold).isNotNull()), [F.col(score)], F.col(f"`{target}`"), number)
    each = lambda b: [np.where(b.fold == i, b.x[:, 0], np.nan) for i in range(len(folds))]
    try:
        found = accepted(rows, each, [Question(i) for i in range(len(folds))], fdr)
        if any(a.threshold is None for a in found):
            raise RuntimeError("scores can't be calibrated: a fold has no accepted target")
        middle = medians(rows, each, len(folds))
    finally:
        rows.close()
    # the threshold is a 4-byte float; the score that it stands for is the least target score that rounds to it or above
    limit = F.lit(None).cast("double")
    for k, i in at.items():
        limit = F.when(F.col(fold) == k, F.lit(found[i].threshold)).otherwise(limit)
    worst = {r[0]: r[1] for r in df.where(F.col(target) & (F.col(score).cast("float") >= limit.cast("float"))).groupBy(fold).agg(F.min(score)).collect()}
    out = F.lit(None).cast("double")
    for k, i in at.items():
        t = float(worst[k])
        m = middle[i] if middle[i] is not None else t - 1.0
        out = F.when(F.col(fold) == k, (F.col(score) - t) / ((t - m) or 1.0)).otherwise(out)
    return df.withColumn(score, out)


def _train(rows: Blocks, best: dict[int, dict], feats: list[str], fdr: float, max_iter: int, direction: str | None, override: bool, search: bool, ks: list[int], start_model: LinearModel | None = None) -> dict[int, LinearModel | None]:
    """A model of each fold, or None where it isn't better than the best feature (the start model, if there is one)."""
    d = len(feats)
    sums = add_up(rows, lambda b: _moments(b, ks), len(ks) * 3 * d).reshape(len(ks), 3 * d)
    scale = {}
    for k in ks:
        n, s, q = np.split(sums.sum(0) - sums[k], 3)
        n = np.maximum(n, 1)
        mean = s / n
        sd = np.sqrt(np.maximum(q / n - mean**2, 0))
        scale[k] = (mean, np.where(sd > 1e-12, sd, 1.0))

    # a labelling: weights and threshold
    if direction is not None:
        best = _race(rows, [feats.index(direction)], fdr, len(ks), ks)
    start: dict[int, tuple[np.ndarray, float] | None] = {}
    for k in ks:
        r = best[k]
        w = np.zeros(d + 1)
        w[r["feature"]] = 1.0 if r["descending"] else -1.0
        start[k] = None if r["threshold"] is None else (w, r["threshold"])
    first_pass = {k: best[k]["passing"] for k in ks}
    if start_model is not None:
        if set(start_model.features) != set(feats):
            raise ValueError("the start model has other features")
        of = dict(zip(start_model.features, zip(start_model.weights, start_model.sd)))
        told = np.append(np.array([of[f][0] / of[f][1] for f in feats]), 0.0)
        used = told[:-1] != 0
        for k, a in zip(ks, accepted(rows, lambda b: [b.x[:, used] @ told[:-1][used]], [Question(0, True, k) for k in ks], fdr, len(ks))):
            first_pass[k], start[k] = a.passing, None if a.threshold is None else (told, a.threshold)
    live = {k for k in ks if start[k] is not None}

    def standard(b: Block, k: int) -> np.ndarray:
        mean, sd = scale[k]
        z = (b.x - mean) / sd
        return np.where(np.isnan(z), 0.0, z)

    def labelled(b: Block, k: int, rule: tuple[np.ndarray, float], raw: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, w = standard(b, k), rule[0]
        if raw:  # a missing value accepts nothing
            used = w[:-1] != 0
            score = b.x[:, used] @ w[:-1][used]
        else:
            score = z @ w[:-1] + w[-1]
        label = np.where(~b.y, -1, np.where(score.astype(np.float32) >= np.float32(rule[1]), 1, 0))
        on = (label != 0) & (b.fold != k)
        return np.column_stack([z[on], np.ones(on.sum())]), label[on].astype(float), b.part[on]

    def fit(problems: list[Problem], rules: dict[int, tuple[np.ndarray, float]], raw: bool, warm: dict[tuple, np.ndarray] | None = None) -> dict[tuple, np.ndarray]:
        size = (d + 1) * (d + 1) + d + 2

        def aggregate(w: dict[tuple, np.ndarray]) -> dict[tuple, tuple[np.ndarray, np.ndarray, float]]:
            asked = [p for p in problems if p.key in w]

            def per_block(b: Block) -> np.ndarray:
                out, made = [], {}
                for p in asked:
                    k, _, left_out = p.key
                    if k not in made:
                        made[k] = labelled(b, k, rules[k], raw)
                    x, t, part = made[k]
                    if left_out >= 0:
                        x, t = x[part != left_out], t[part != left_out]
                    g, r, loss = margin_terms(x, t, w[p.key], p.positive, p.negative)
                    out.append(np.concatenate([g.ravel(), r, [loss]]))
                return np.concatenate(out)

            total = add_up(rows, per_block, size * len(asked)).reshape(len(asked), size)
            return {p.key: (v[: (d + 1) ** 2].reshape(d + 1, d + 1), v[(d + 1) ** 2 : -1], float(v[-1])) for p, v in zip(asked, total)}

        return newton(problems, d, aggregate, start=warm)

    weights_of = {k: (1.0, 1.0) for k in live}
    if search and live:
        problems = [Problem((k, c, v), *GRID[c]) for k in sorted(live) for c in range(len(GRID)) for v in range(CV_PARTS)]
        w = fit(problems, start, True)

        def hits(b: Block) -> np.ndarray:
            out = np.zeros(len(problems))
            made = {k: labelled(b, k, start[k], True) for k in live}
            for i, p in enumerate(problems):
                x, t, part = made[p.key[0]]
                on = part == p.key[2]
                out[i] = np.sum((x[on] @ w[p.key] > 0) == (t[on] > 0))
            return out

        right = add_up(rows, hits, len(problems))
        for k in live:
            score = [sum(r for r, p in zip(right, problems) if p.key[:2] == (k, c)) for c in range(len(GRID))]
            weights_of[k] = GRID[int(np.argmax(score))]

    rules, raw = start, True
    passing = dict(first_pass)
    current: dict[int, np.ndarray] = {}
    for _ in range(max_iter):
        asked = sorted(live)
        if not asked:
            break
        problems = [Problem((k, 0, -1), *weights_of[k]) for k in asked]
        fitted = fit(problems, rules, raw, {(k, 0, -1): w for k, w in current.items()})
        current = {k: fitted[(k, 0, -1)] for k in asked}
        now = current
        found = accepted(rows, lambda b: [np.where(b.fold == k, np.nan, standard(b, k) @ now[k][:-1] + now[k][-1]) for k in asked], [Question(i) for i in range(len(asked))], fdr)
        rules, raw = {}, False
        for k, a in zip(asked, found):
            passing[k] = a.passing
            if a.threshold is None:
                live.discard(k)
            else:
                rules[k] = (current[k], a.threshold)
    out: dict[int, LinearModel | None] = {}
    for k in ks:
        better = k in live and k in current and (override or passing[k] > first_pass[k])
        mean, sd = scale[k]
        out[k] = LinearModel(tuple(feats), tuple(map(float, mean)), tuple(map(float, sd)), tuple(map(float, current[k][:-1])), float(current[k][-1]), k) if better else None
        if out[k] is None and start_model is not None:
            out[k] = dataclasses.replace(start_model, fold=k)
        log.info("fold %d: %d accepted, best feature %d", k, passing[k], first_pass[k])
    return out


def _moments(b: Block, ks: list[int]) -> np.ndarray:
    """Of each fold the number, sum and sum of squares of each feature's values."""
    x, fold = b.x, b.fold
    return np.concatenate([np.concatenate([np.sum(~np.isnan(x[fold == k]), 0), np.nansum(x[fold == k], 0), np.nansum(x[fold == k] ** 2, 0)]) for k in ks])


def brew_joint(datasets: list[PsmDataset], **options: object) -> list[BrewResult]:
    """One training on several datasets with the same features; scores and confidence stay apart."""
    sets = [set(ds.roles.features) for ds in datasets]
    if any(s != sets[0] for s in sets):
        raise ValueError("datasets must have the same features")
    roles = datasets[0].roles
    pooled = None
    for i, ds in enumerate(datasets):
        part = ds.df.withColumn("_dataset", F.lit(i))
        pooled = part if pooled is None else pooled.unionByName(part, allowMissingColumns=True)
    wide = dataclasses.replace(roles, columns=tuple(pooled.columns), spectrum=("_dataset", *roles.spectrum))
    r = brew(PsmDataset(pooled, wide), **options)
    return [dataclasses.replace(r, scored=r.scored.where(F.col("_dataset") == i).drop("_dataset")) for i in range(len(datasets))]

