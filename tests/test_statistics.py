"""Q-values, error probabilities, histograms, monotone fits: golden vectors, brute force, invariants."""

import numpy as np
import pytest
from compare import TABLES
from pyspark.sql import functions as F

from peptrail.operators import prefix
from peptrail.operators.histogram import Histogram, bin_count, bin_edges, histogram, interpolate, score_statistics
from peptrail.operators.isotonic import isotonic, monotone_mean, monotone_rates, running
from peptrail.operators.peps import CURVES, peps, pi0_by_slope, pi0_slope
from peptrail.operators.qvalues import coerce_target, curve_from_histogram, discovery_curve, from_counts, from_histogram, from_peps, qvalues, tdc, training_rows, update_labels
from peptrail.plans import core_queries

SCORES = [10, 10, 9, 8, 7, 7, 6, 5, 4, 3, 2, 2, 1, 1, 1, 1]
TARGETS = [1, 1, 1, 1, 0, 1, 1, 0, 1, 0, 1, 0, 0, 0, 0, 0]
EXPECTED = [1 / 4] * 4 + [2 / 6] * 3 + [3 / 7] * 2 + [4 / 7] + [5 / 8] * 2 + [1] * 4


def frame(spark, scores, targets):
    return spark.createDataFrame([(i, float(s), bool(t)) for i, (s, t) in enumerate(zip(scores, targets))], "id long, score double, target boolean")


def ordered(df, c="q_value"):
    return [r[c] for r in df.orderBy("id").collect()]


def brute_tdc(scores, targets, descending=True):
    s = np.asarray(scores, np.float32) * (1 if descending else -1)
    t = np.asarray(targets, bool)
    o = np.lexsort((t, -s))
    ct, cd = np.cumsum(t[o]), np.cumsum(~t[o])
    fdr = np.minimum(np.where(ct > 0, (cd + 1) / np.maximum(ct, 1), 1), 1).astype(np.float32)
    q = np.minimum.accumulate(fdr[::-1])[::-1]
    out = np.empty(len(s), np.float32)
    for v in np.unique(s):
        out[s == v] = q[s[o] == v].min()
    out[out == out[o[-1]]] = 1
    return out


def test_tdc_golden(spark):
    assert np.allclose(ordered(tdc(frame(spark, SCORES, TARGETS), "score", "target")), EXPECTED)
    assert np.allclose(ordered(tdc(frame(spark, [-s for s in SCORES], TARGETS), "score", "target", False)), EXPECTED)
    assert np.allclose(ordered(from_counts(frame(spark, SCORES, TARGETS), "score", "target")), EXPECTED)


@pytest.mark.parametrize("seed", [1, 2])
def test_tdc_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    s, t = rng.integers(0, 40, 300), rng.random(300) < 0.6
    for descending in (True, False):
        assert np.allclose(ordered(tdc(frame(spark, s, t), "score", "target", descending)), brute_tdc(s, t, descending))


def test_tdc_parts_are_independent(spark):
    a = frame(spark, SCORES, TARGETS).withColumn("part", F.lit("a"))
    b = frame(spark, SCORES[:6], TARGETS[:6]).withColumn("part", F.lit("b")).withColumn("id", F.col("id") + 100)
    got = ordered(tdc(a.union(b), "score", "target", parts=["part"]))
    assert np.allclose(got, [*EXPECTED, *brute_tdc(SCORES[:6], TARGETS[:6])])


def test_edges(spark):
    empty = frame(spark, [], [])
    assert tdc(empty, "score", "target").count() == 0
    assert peps(empty, "score", "target", "hist_nnls").count() == 0
    with_null = frame(spark, [3, 2], [1, 0]).union(spark.createDataFrame([(9, None, True)], "id long, score double, target boolean"))
    assert ordered(tdc(with_null, "score", "target"))[-1] is None
    assert ordered(tdc(frame(spark, [1, 2], [0, 0]), "score", "target")) == [1.0, 1.0]
    with pytest.raises(Exception, match="NaN"):
        tdc(frame(spark, [float("nan")], [1]), "score", "target").collect()
    with pytest.raises(ValueError):
        qvalues(empty, "score", "target", "other")


def test_from_peps(spark):
    rng = np.random.default_rng(3)
    s, t = rng.normal(size=60), rng.random(60) < 0.7
    p = 1 / (1 + np.exp(2 * s))
    df = spark.createDataFrame([(i, float(a), bool(b), float(c)) for i, (a, b, c) in enumerate(zip(s, t, p))], "id long, score double, target boolean, pep double")
    o = np.argsort(-s[t])
    mean = np.cumsum(p[t][o]) / np.arange(1, t.sum() + 1)
    q = np.minimum.accumulate(mean[::-1])[::-1]
    assert np.allclose(ordered(from_peps(df, "score", "target", "pep")), np.interp(s, s[t][o][::-1], q[::-1]))


@pytest.mark.skipif(not TABLES.exists(), reason="the tables aren't here")
def test_q_values_of_all_records_have_the_decoys(spark):
    rows = core_queries._psm(spark, str(TABLES)).toPandas()
    found = dict(map(tuple, core_queries.QUERIES["qvalues_from_peps_all"](spark, str(TABLES)).collect()))
    t, s = rows.target.to_numpy(bool), rows.score.to_numpy(float)
    x, n = np.unique(s[t], return_counts=True)
    p = 1 / (1 + np.exp(x - 2))
    mean = np.cumsum((p * n)[::-1]) / np.cumsum(n[::-1])
    q = np.minimum.accumulate(mean[::-1])
    assert (~t).sum() > 0 and set(found) == set(rows.row_id)
    assert np.allclose([found[i] for i in rows.row_id], np.interp(s, x, q), rtol=0, atol=2e-6)


def simulated(spark, n=4000, seed=5):
    rng = np.random.default_rng(seed)
    right = np.maximum(rng.normal(3, 2, n), rng.normal(-4, 2, n))
    t = np.where(rng.random(n) < 0.3, right, rng.normal(-4, 2, n))
    return frame(spark, np.concatenate([t, rng.normal(-4, 2, n)]), [1] * n + [0] * n)


def test_histogram_q_is_near_the_exact_one(spark):
    df = simulated(spark)
    a = np.array(ordered(from_counts(df, "score", "target")))
    b = np.array(ordered(from_histogram(df, "score", "target")))
    assert np.max(np.abs(a - b)) < 0.04 and np.mean(np.abs(a - b)) < 0.01


@pytest.mark.parametrize("method", list(CURVES))
def test_peps_are_bounded_monotone_and_sensible(spark, method):
    rows = peps(simulated(spark), "score", "target", method).orderBy("score").collect()
    p = np.array([r["pep"] for r in rows])
    s = np.array([r["score"] for r in rows])
    assert p.min() >= 0 and p.max() <= 1 and np.all(np.diff(p) <= 1e-9)
    assert p[s < -4].mean() > 0.7 and p[s > 3].mean() < 0.1


def test_peps_error(spark):
    df = frame(spark, np.arange(60), [0, 1] * 30)
    with pytest.raises(ValueError):
        peps(df.withColumn("target", F.col("score") < -1), "score", "target", "kde_nnls", peps_error=True)
        peps(frame(spark, [1.0] * 9, [0, 1, 0] * 3), "score", "target", "hist_nnls", peps_error=True)


def test_isotonic_golden():
    assert np.allclose(isotonic([2, 3, 1], [2, 1, 10], False), [7 / 3, 7 / 3, 1])
    assert np.allclose(isotonic([2, 3, 1], [3, 1, 1]), [2, 2, 2])
    assert np.allclose(isotonic([2, 3, 1], [1, 3, 1]), [2, 2.5, 2.5])
    assert np.allclose(running([1, 2, 1, 3]), [1, 2, 2, 3]) and np.allclose(running([3, 2, 3, 1], False), [3, 2, 2, 1])
    assert np.all(np.diff(monotone_mean([1, 3, 2, 5])) >= 0)


def test_rates_golden():
    n, k = [0, 2, 1, 0, 1, 0, 2, 0], [1, 0, 0, 1, 1, 1, 2, 1]
    assert np.allclose(monotone_rates(n, k, True), [0, 0, 0, 0.5, 1, 1, 1, 1])
    assert np.allclose(monotone_rates(n[::-1], k[::-1], False), [0, 0, 0, 0.5, 1, 1, 1, 1][::-1])
    assert np.allclose(monotone_rates([0, 0], [1, 1]), [0, 0])


def test_bins(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    df = frame(spark, x, rng.random(500) < 0.5)
    for rule in ("scott", "sturges"):
        assert np.allclose(bin_edges(df, "score", rule), np.histogram_bin_edges(x, rule))
    assert len(bin_edges(df, "score", "terrell_scott")) == 11
    h = histogram(df, "score", "target")
    assert np.array_equal(np.array(h.targets) + np.array(h.decoys), np.histogram(x, "scott")[0])
    assert bin_count(10, 0, 1, 0.0) >= 1 and bin_count(10, 1, 1, 0.0) == 1
    with pytest.raises(ValueError):
        bin_edges(df, "score", "none")


def test_statistics(spark):
    r = score_statistics(frame(spark, [1, 2, 3, 4, 5], [1] * 5), "score").first()
    assert (r["n"], r["mean"], r["var"]) == (5, 3, 2.5) and abs(r["sd"] - 1.5811388300841898) < 1e-12
    assert score_statistics(frame(spark, [4], [1]), "score").first()["var"] == 0.0


def test_interpolate(spark):
    xs = [-1.0, 0.0, 0.25, 1.7, 2.0, 9.0]
    df = frame(spark, xs, [1] * 6).withColumn("v", interpolate(F.col("score"), 0.0, 1.0, [1.0, 3.0, 2.0]))
    assert np.allclose(ordered(df, "v"), np.interp(xs, [0, 1, 2], [1, 3, 2]))


def test_curve_reaches_zero_at_the_right_end():
    assert curve_from_histogram(Histogram(0.0, 2.0, [5, 9], [5, 0]))[-1] == 0.0


def test_pi0(spark):
    d = np.array([1, 5, 9, 30, 60, 90, 100, 50])
    assert abs(pi0_by_slope(0.7 * d, d) - 0.7) < 1e-9
    assert 0.3 < pi0_slope(simulated(spark), "score", "target").first()["pi0"] < 1.1


def test_labels(spark):
    df = frame(spark, [6, 5, 3, 3, 2, 1], [1, 1, 1, 0, 0, 0])
    assert ordered(update_labels(df, "score", "target", 0.5), "label") == [1, 1, 0, -1, -1, -1]
    assert sorted(r["y"] for r in training_rows(update_labels(df, "score", "target", 0.5)).collect()) == [0, 0, 0, 1, 1]


def test_target_coercion(spark):
    for values in ([0, 1], [1, -1], ["1", "-1"], [True, False], [0.0, 1.0]):
        df = spark.createDataFrame([(v,) for v in values], ["target"])
        assert {r[0] for r in coerce_target(df, "target").collect()} == {True, False}
    for values in ([1, 1], [-1, 0, 1], ["a", "b"], [0, 2]):
        with pytest.raises(ValueError):
            coerce_target(spark.createDataFrame([(v,) for v in values], ["target"]), "target")


def test_discovery_curve(spark):
    q = tdc(frame(spark, SCORES, TARGETS), "score", "target")
    rows = {round(r["q_value"], 4): r["discoveries"] for r in discovery_curve(q).collect()}
    assert rows[0.25] == 4 and rows[0.3333] == 6 and rows[0.625] == 8


def test_large_tables_take_the_two_phase_scan(spark, monkeypatch):
    from peptrail.operators import prefix

    rng = np.random.default_rng(9)
    s, t = rng.integers(0, 50, 400), rng.random(400) < 0.6
    df = frame(spark, s, t)
    small = [ordered(f(df, "score", "target")) for f in (tdc, from_counts)]
    monkeypatch.setattr(prefix, "SMALL_BYTES", -1)
    large = [ordered(f(df, "score", "target")) for f in (tdc, from_counts)]
    assert np.allclose(small, large) and np.allclose(large[0], brute_tdc(s, t))
    assert np.allclose(ordered(tdc(df, "score", "target", False)), brute_tdc(s, t, False))
    parts = tdc(df.withColumn("p", F.col("id") % 2), "score", "target", parts=["p"])
    assert np.allclose(ordered(parts.where("p = 1")), brute_tdc(s[1::2], t[1::2]))


@pytest.mark.parametrize("buckets", [2, 5, 700])
def test_scan_by_buckets_of_any_number(spark, buckets):
    rng = np.random.default_rng(buckets)
    v = sorted(set(np.round(rng.normal(size=900), 3).tolist()))
    df = spark.createDataFrame([(x, int(rng.integers(0, 9))) for x in v], "v double, n long").repartition(5)
    b = prefix.bucketed(df, [], "v", buckets)
    got = {r["v"]: (r["s"], r["m"]) for r in prefix.scan(b, [], "v", True, {"s": ("sum", "n"), "m": ("max", "n")}).collect()}
    rows = sorted(map(tuple, df.collect()), reverse=True)
    total, top = np.cumsum([n for _, n in rows]), np.maximum.accumulate([n for _, n in rows])
    assert got == {x: (int(a), int(t)) for (x, _), a, t in zip(rows, total, top)}
    assert [r[0] for r in b.groupBy(prefix.BUCKET).agg({"v": "max"}).orderBy(prefix.BUCKET).select("max(v)").collect()] == sorted(r[0] for r in b.groupBy(prefix.BUCKET).agg({"v": "max"}).select("max(v)").collect())


def test_no_silent_caps(spark, monkeypatch):
    from peptrail.functions import search_features
    from peptrail.operators.histogram import bin_count

    monkeypatch.setattr(search_features, "MOST_VALUES", 3)
    df = spark.range(5)
    with pytest.raises(ValueError):
        search_features.one_hot(df, "id", "is_")
    assert search_features.one_hot(df, "id", "is_", [1, 2, 3, 4]).columns == ["id", "is_1", "is_2", "is_3", "is_4"]
    with pytest.raises(ValueError):
        bin_count(10**9, 0.0, 1e12, 1.0)
    assert bin_count(10**9, 0.0, 1e12, 1.0, clip=(50, 500)) == 500


def test_logs_of_written_numbers(spark):
    from peptrail.functions.search_features import auto_log

    df = spark.createDataFrame([(1, "1e-400", "5"), (2, "2.0E-3", "7.5"), (3, "0", "6"), (4, None, "x")], "id int, e string, plain string")
    r = {x["id"]: x for x in auto_log(df, ["e", "plain"]).collect()}
    assert r[1]["e"] == -400.0 and abs(r[2]["e"] - np.log10(2e-3)) < 1e-12 and r[3]["e"] == -401.0 and r[4]["e"] is None
    assert [r[i]["plain"] for i in (1, 2, 3, 4)] == [5.0, 7.5, 6.0, None]
