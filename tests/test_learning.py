"""Thresholds, medians and the whole training against plain NumPy versions that sort."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peptrail.dataset import PsmDataset
from peptrail.learn.blocks import add_up, pack
from peptrail.learn.brew import CV_PARTS, GRID, best_features, brew, calibrate
from peptrail.learn.svm import fit_local
from peptrail.learn.thresholds import Question, accepted, float_of, medians, ordered_bits
from peptrail.operators.qvalues import tdc


def plain_accept(score: np.ndarray, y: np.ndarray, fdr: float, descending: bool = True) -> tuple[int, float | None]:
    """Accepted targets and the worst accepted score, by sorting."""
    s = (score if descending else -score).astype(np.float32)
    on = ~np.isnan(s)
    s, y = s[on], y[on]
    rates, ct, cd = [], 0, 0
    for v in sorted(set(s.tolist()), reverse=True):
        t, d = int((y & (s == v)).sum()), int((~y & (s == v)).sum())
        first = (cd + 2) / ct if d and ct else 1.0
        ct, cd = ct + t, cd + d
        rates.append((v, float(np.float32(min(1.0, first, (cd + 1) / ct if ct else 1.0))), ct))
    ok = [(v, n) for v, r, n in rates if r <= fdr and r < rates[-1][1]]
    return (ok[-1][1], ok[-1][0]) if ok else (0, None)


def frame(n: int, seed: int, digits: int = 9) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.6
    x = {f"f{i}": np.round(rng.normal(size=n) + (y & (rng.random(n) < 0.5)) * (2.5 if i == 0 else 1.5), digits) for i in range(4)}
    x["f1"] = -x["f1"]
    df = pd.DataFrame({"id": np.arange(n), "target": y, "fold": rng.integers(0, 3, n), **x})
    df.loc[::11, "f2"] = np.nan
    return df


@pytest.mark.parametrize(("seed", "digits", "fdr"), [(1, 9, 0.05), (2, 1, 0.05), (3, 0, 0.2), (4, 9, 0.001), (5, 1, 0.6)])
def test_thresholds_and_medians_as_by_sorting(spark, seed, digits, fdr):
    pdf = frame(1500, seed, digits)
    df = spark.createDataFrame(pdf).repartition(5)
    rows = pack(df, [F.col(f"f{i}") for i in range(4)], F.col("target"), F.col("fold"))
    asked = [Question(i, down, without) for i in range(4) for down in (True, False) for without in (None, 0, 2)]
    found = accepted(rows, lambda b: [b.x[:, i] for i in range(4)], asked, fdr, 3)
    for q, a in zip(asked, found):
        on = np.ones(len(pdf), bool) if q.without is None else (pdf["fold"] != q.without).to_numpy()
        assert (a.passing, a.threshold) == plain_accept(pdf[f"f{q.slot}"].to_numpy()[on], pdf["target"].to_numpy()[on], fdr, q.descending), q
    decoys = pdf[~pdf["target"]]
    for i, m in enumerate(medians(rows, lambda b: [b.x[:, i] for i in range(4)], 4)):
        assert m == np.nanmedian(decoys[f"f{i}"])
    best = best_features(df, [f"f{i}" for i in range(4)], "target", fdr).first()
    plain = [(plain_accept(pdf[f"f{i}"].to_numpy(), pdf["target"].to_numpy(), fdr, down), i, down) for i in range(4) for down in (True, False)]
    (n, t), i, down = max(plain, key=lambda p: (p[0][0], -p[1], p[2]))
    assert (best["feature"], best["descending"], best["passing"], best["threshold"]) == (f"f{i}", down, n, t)
    # the same as the q-values say
    assert tdc(df.where("not isnan(f2)"), "f2", "target").where(f"target and q_value <= {fdr}").count() == next(a.passing for q, a in zip(asked, found) if q == Question(2))
    rows.close()


def test_order_of_bits():
    for kind, widths in ((np.float32, (12, 10, 10)), (np.float64, (12, 13, 13, 13, 13))):
        v = np.array([-np.inf, -3.5, -1e-30, -0.0, 0.0, 1e-30, 2.0, np.inf], kind)
        bits = ordered_bits(v)
        assert (np.diff(bits.astype(object)) >= 0).all() and bits[3] == bits[4]
        assert [float_of(int(b), widths) for b in bits] == [float(x) for x in v]


def test_no_rows_no_scores(spark):
    empty = spark.createDataFrame([], "target boolean, f double, fold int")
    r = best_features(empty, ["f"], "target", 0.05).first()
    assert (r["passing"], r["threshold"]) == (0, None)
    assert calibrate(empty, "f", "target", "fold", 0.1).count() == 0
    nulls = spark.createDataFrame([(True, None, 0), (None, 2.0, 0), (False, 1.0, None)], "target boolean, f double, fold int")
    assert best_features(nulls, ["f"], "target", 0.05).first()["passing"] == 0
    with pytest.raises(RuntimeError):
        calibrate(nulls, "f", "target", "fold", 0.1)


def test_sums_of_many_tasks_go_through_a_tree(spark):
    rows = pack(spark.range(2000).repartition(150).select("id", (F.col("id") > 9).alias("y")), [F.col("id")], F.col("y"))
    assert rows.tasks == 150
    assert add_up(rows, lambda b: np.array([b.x.sum(), float(len(b.y)), float(b.y.sum())]), 3).tolist() == [1999000.0, 2000.0, 1990.0]
    rows.close()


def plain_training(pdf: pd.DataFrame, features: list[str], fdr: float, iterations: int) -> np.ndarray:
    """Raw scores of each row by the models that didn't see it; the row's fold and part come with the data."""
    x, y, fold, part = pdf[features].to_numpy(float), pdf["target"].to_numpy(), pdf["fold"].to_numpy(), pdf["part"].to_numpy()
    out = np.full(len(pdf), np.nan)
    for k in range(3):
        on = fold != k
        mean, sd = x[on].mean(0), x[on].std(0)
        z = (x - mean) / sd
        options = [(plain_accept(x[on, i], y[on], fdr, down), -i, down) for i in range(len(features)) for down in (True, False)]
        (_, threshold), i, down = max(options, key=lambda o: (o[0][0], o[1], o[2]))
        score = x[:, -i] if down else -x[:, -i]

        def rows(score: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
            label = np.where(~y, -1, np.where(score.astype(np.float32) >= np.float32(threshold), 1, 0))
            use = on & (label != 0)
            return use, label

        use, label = rows(score, threshold)
        right = []
        for p, n in GRID:
            hits = 0
            for v in range(CV_PARTS):
                w = fit_local(z[use & (part != v)], label[use & (part != v)].astype(float), p, n)
                test = use & (part == v)
                hits += int(((z[test] @ w[:-1] + w[-1] > 0) == (label[test] > 0)).sum())
            right.append(hits)
        p, n = GRID[int(np.argmax(right))]
        for _ in range(iterations):
            use, label = rows(score, threshold)
            w = fit_local(z[use], label[use].astype(float), p, n)
            score = z @ w[:-1] + w[-1]
            _, threshold = plain_accept(score[on], y[on], fdr)
        out[fold == k] = score[fold == k]
    return out


def test_training_as_in_numpy(spark):
    pdf = frame(900, 7).drop(columns=["fold"]).rename(columns={"id": "SpecId"})
    pdf["f2"] = pdf["f2"].fillna(0.0)
    pdf["ScanNr"], pdf["ExpMass"], pdf["Peptide"], pdf["Proteins"] = pdf["SpecId"], 1.0, "K", "p"
    pdf["Label"] = np.where(pdf.pop("target"), 1, -1)
    ds = PsmDataset.of(spark.createDataFrame(pdf))
    r = brew(ds, 0.05, 0.05, override=True)
    assert r.used == "model"
    part = F.abs(F.xxhash64(F.lit(1), *[F.col(c) for c in ds.roles.spectrum]) % CV_PARTS).alias("part")
    got = r.scored.select("*", part).toPandas().rename(columns={"Label": "target"})
    plain = plain_training(got, list(ds.roles.features), 0.05, 10)
    for k in range(3):
        a, b = got["score"][got["fold"] == k].to_numpy(), plain[got["fold"] == k]
        b = (b - b.mean()) / b.std()
        assert np.max(np.abs((a - a.mean()) / a.std() - b)) < 1e-3  # calibration shifts and scales
        y = got["target"][got["fold"] == k].to_numpy()
        assert plain_accept(a, y, 0.05)[0] == plain_accept(plain[got["fold"] == k], y, 0.05)[0]
