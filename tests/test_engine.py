"""Roles, sources, competition, proteins, learning, confidence, sinks, streaming and the command line."""

import inspect
import json
import sqlite3

import numpy as np
import pandas as pd
import pytest
import brute
from compare import TABLES
from pyspark.sql import functions as F

from peptrail import cli
from peptrail.confidence import assign_confidence, write_confidence
from peptrail.dataset import PsmDataset
from peptrail.functions import peptides as pf
from peptrail.functions import search_features as sf
from peptrail.learn.brew import LinearModel, best_features, brew, brew_joint, load_models, save_models
from peptrail.learn.svm import fit_local
from peptrail.operators import competition as comp
from peptrail.operators import proteins, skew
from peptrail.operators.proteins import contained_proteins, group_proteins, match_decoys, picked_proteins
from peptrail.plans import core_queries
from peptrail.roles import infer_roles
from peptrail.sinks.writers import fasta_lines, output_path, to_flashlfq, write_sqlite, write_table
from peptrail.sources.fasta import read_fasta, read_proteins
from peptrail.sources.pepxml import read_pepxml
from peptrail.sources.tables import in_memory, is_ragged_pin, read_pin, read_results, read_table
from peptrail.streaming.histogram_confidence import histogram_confidence, start_stream


def psm_pandas(n=1500, seed=42, shift=3.0):
    rng = np.random.default_rng(seed)
    target = np.arange(n) % 2 == 0
    right = target & (rng.random(n) < 0.5)
    peptide = ["".join(rng.choice(list("ACDEFGH"), 6)) + "K" for _ in range(n)]
    return pd.DataFrame({
        "SpecId": np.arange(n), "Label": np.where(target, 1, -1), "ScanNr": np.arange(n) // 2, "ExpMass": 500.0 + np.arange(n) // 2, "CalcMass": 500.0,
        "f1": rng.normal(size=n) + shift * right, "f2": rng.normal(size=n) - 2 * right, "f3": rng.normal(size=n), "ModifiedPeptide": peptide, "Peptide": peptide, "Proteins": [("" if t else "decoy_") + f"p{i % 40}" for i, t in enumerate(target)],
    })


@pytest.fixture(scope="module")
def pin(tmp_path_factory):
    path = tmp_path_factory.mktemp("pin") / "a.pin"
    psm_pandas().to_csv(path, sep="\t", index=False)
    return str(path)


def test_roles():
    r = infer_roles(["sPeCid", "LaBel", "pepTide", "sCore", "scanNR", "pRoteins", "modifiedPEPTIDE", "charge2", "charge_column"])
    assert (r.id, r.target, r.peptide, r.protein, r.spectrum, r.levels) == ("sPeCid", "LaBel", "pepTide", "pRoteins", ("scanNR",), ("modifiedPEPTIDE",))
    assert r.features == ("sCore", "charge2")
    for bad in (["SpecId", "Label", "ScanNr"], ["SpecId", "Label", "label", "ScanNr", "Peptide", "Proteins"]):
        with pytest.raises(ValueError):
            infer_roles(bad)
    with pytest.raises(ValueError):
        infer_roles(["SpecId", "Label", "ScanNr", "Peptide", "Proteins"], rt="rt")


def test_sources(spark, tmp_path, pin):
    (tmp_path / "r.pin").write_text("SpecId\tLabel\tScanNr\tPeptide\tProteins\nDefaultDirection\t-\t0\t-\t-\na\t1\t5\tK\tp1\tp2\nb\t-1\t6\tR\tp3\n")
    assert is_ragged_pin(spark, str(tmp_path / "r.pin"))
    rows = {r["SpecId"]: r for r in read_table(spark, str(tmp_path / "r.pin")).collect()}
    assert rows["a"]["Proteins"] == "p1:p2" and rows["b"]["ScanNr"] == 6 and len(rows) == 2
    assert read_table(spark, pin, ["f1", "Label"]).columns == ["f1", "Label"]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert read_table(spark, str(tmp_path / "t.csv"), renames={"b": "c"}).columns == ["a", "c"]
    (tmp_path / "t.odd").write_text("a\tb\n1\t2\n")
    with pytest.warns(UserWarning):
        assert read_table(spark, str(tmp_path / "t.odd")).count() == 1
    (ds,) = read_pin(spark, pin)
    assert ds.roles.features == ("f1", "f2", "f3") and ds.targets.count() == ds.decoys.count() == 750
    assert in_memory(spark, np.array([[1], [2]])).count() == 2
    with pytest.raises(ValueError):
        in_memory(spark, np.ones((2, 2)))


def test_dataset_checks(spark):
    df = spark.createDataFrame(psm_pandas(20))
    with_null = df.withColumn("f3", F.when(F.col("SpecId") > 3, F.col("f3")))
    assert PsmDataset.of(with_null).roles.features == ("f1", "f2")
    assert PsmDataset.of(with_null, drop_na_features=False).roles.features == ("f1", "f2", "f3")
    for bad in (df.limit(0), df.where("Label = 1")):
        with pytest.raises(ValueError):
            PsmDataset.of(bad)


def test_pepxml(spark, tmp_path):
    hit = '<search_hit peptide="ABCM" protein="{}" calc_neutral_pep_mass="100.1" num_missed_cleavages="1" num_tol_term="2" num_matched_peptides="10"><alternative_protein protein="p2 x"/><modification_info><mod_aminoacid_mass position="4" mass="147.03"/></modification_info><search_score name="e" value="{}"/></search_hit>'
    query = '<spectrum_query spectrum="s" end_scan="{}" assumed_charge="{}" retention_time_sec="3.5" precursor_neutral_mass="100.2"><search_result>{}</search_result></spectrum_query>'
    body = query.format(1, 2, hit.format("decoy_p", "1e-8") + hit.format("p", "0.1")) + query.format(2, 3, hit.format("decoy_p", "0.5").replace("p2 x", "decoy_p2"))
    (tmp_path / "x.pep.xml").write_text(f'<msms_pipeline_analysis><msms_run_summary base_name="run" raw_data=".mzML">{body}</msms_run_summary></msms_pipeline_analysis>')
    rows = read_pepxml(spark, str(tmp_path / "x.pep.xml")).orderBy("scan", "proteins").collect()
    assert len(rows) == 3 and rows[0]["peptide"] == "ABCM[147.03]" and rows[0]["ms_data_file"] == "run.mzML"
    assert [r["label"] for r in rows] == [True, True, False] and [r["charge_2"] for r in rows] == [1, 1, 0] and rows[0]["e"] == -8.0
    (tmp_path / "y.pep.xml").write_text((tmp_path / "x.pep.xml").read_text().replace('name="e"', 'name="Percolator PEP"'))
    with pytest.raises(ValueError):
        read_pepxml(spark, str(tmp_path / "y.pep.xml"))


def test_peptide_functions(spark):
    df = spark.createDataFrame([(p,) for p in ("A.B.C", "nABCc", "BL[+mod]AH", "A.B[1.1].C")], ["p"])
    assert [r["stripped_sequence"] for r in pf.strip_peptides(df, "p").collect()] == ["B", "ABC", "BLAH", "B"]
    assert pf.strip_peptides(spark.createDataFrame([("abc",)], ["p"]), "p").first()["stripped_sequence"] == "ABC"
    assert pf.digest_sequence("AAKBBRPCCKD", missed_cleavages=0, min_length=1) == {"AAK", "BBRPCCK", "D"}
    assert len(pf.digest_sequence("AAAAAKBBBBBRPCCCCCKRDDDDKEEEEEE", "[KR]", 2)) == 13
    assert pf.digest_sequence("MAK", min_length=1, clip_nterm_methionine=True) == {"MAK", "AK"}
    assert pf.digest_sequence("ABCK", min_length=3, semi=True) == {"ABCK", "ABC", "BCK"}
    assert pf.digest_sequence("", min_length=1) == set()
    d = pf.decoy_sequence("MAAAKCDEFR", "[KR]")
    assert d[0] == "M" and d[4] == "K" and d[-1] == "R" and sorted(d) == sorted("MAAAKCDEFR")
    assert pf.decoy_sequence("ABCDK", reverse=True) == "ADCBK"
    s = spark.createDataFrame([(1, "AAKBBRCC"), (2, None), (3, "")], "id long, s string")
    a = {tuple(r) for r in pf.digest_sql(s, "id", "s", 1, 2, 9).collect()}
    assert a == {tuple(r) for r in pf.digest(s, "id", "s", enzyme="[KR]", missed_cleavages=1, min_length=2, max_length=9).collect()}


def test_search_features(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 1e-6, 2.0), (3, 1.0, 3.0)], "id long, e double, x double")
    r = sf.auto_log(df, ["e", "x"]).orderBy("id").collect()
    assert [x["e"] for x in r] == [-7.0, -6.0, 0.0] and r[0]["x"] == 1.0
    z = [x["x"] for x in sf.zscore(df, ["x"]).orderBy("id").collect()]
    assert abs(sum(z)) < 1e-9 and abs(np.std(z) - 1) < 1e-9
    assert sf.nan_features(df.withColumn("x", F.when(F.col("id") > 1, float("nan")).otherwise(F.col("x"))), ["e", "x"]) == ["x"]


def test_competition(spark):
    df = spark.createDataFrame([(1, "s", 5.0, True), (2, "s", 5.0, False), (3, "t", 1.0, True), (4, "t", None, True), (5, None, 2.0, True), (6, "t", 1.0, True)], "id long, k string, score double, target boolean")
    assert {r["id"] for r in comp.best_per_group(df, ["k"], "score", "target", ["id"]).collect()} == {2, 3, 5}
    picks = {s: {r["id"] for r in comp.best_per_group_random(df.where("k is not null"), ["k"], "score", "id", s).collect()} for s in range(8)}
    assert len({frozenset(p) for p in picks.values()}) > 1
    rolled = comp.rollup(df, {"a": ["k"], "b": ["target"]}, "score", "target", "id")
    assert {(r["level"], r["id"]) for r in rolled.collect()} == {("a", 2), ("a", 3), ("b", 1), ("b", 2)}
    assert comp.best_per_group(df.limit(0), ["k"], "score").count() == 0
    assert comp.reachable_levels("psm") == ["psm", "precursor", "modified_peptide", "peptide", "peptide_group"] and comp.reachable_levels("peptide") == ["peptide"]


def test_folds_and_samples(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") / 3).cast("int").alias("scan"))
    f = comp.fold_split(df, ["scan"], 3).toPandas()
    assert f.groupby("scan").fold.nunique().max() == 1 and f.groupby("fold").size().between(950, 1050).all() and sorted(f.fold.unique()) == [0, 1, 2]
    s = comp.training_sample(df.withColumn("part", F.col("id") % 2), ["part"], "id", 100)
    assert [r["count"] for r in s.groupBy("part").count().collect()] == [100, 100] and s.distinct().count() == 200


def test_proteins(spark, tmp_path):
    m = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "2"), ("c", "3")], "protein string, peptide string")
    more = m.union(spark.createDataFrame([("a2", "1"), ("a2", "2"), ("a2", "2")], m.schema))
    assert {tuple(r) for r in contained_proteins(more).collect()} == {("a", 2, "a", None), ("a2", 2, "a", None), ("b", 1, "b", "a"), ("c", 2, "c", None)}
    t = group_proteins(m)
    assert {tuple(r) for r in t.peptide_map.collect()} == {("1", "a, b"), ("3", "c")} and {tuple(r) for r in t.shared.collect()} == {("2", "a"), ("2", "c")}
    d = spark.createDataFrame([("ABC",), ("CAB",), ("XY",)], ["peptide"])
    g = spark.createDataFrame([("BCA",), ("ACB",), ("ZZ",)], ["peptide"])
    assert {r["target"] for r in match_decoys(d, g).collect()} == {"BCA", "ACB"}
    (tmp_path / "p.fasta").write_text(">p1 desc\nABCDEFGHK\nLLLLLLLR\n>p2\nLLLLLLLR\n>decoy_p1 x\nGGGGGGGK\n>empty\n")
    fa = {r["protein"]: r["sequence"] for r in read_fasta(spark, str(tmp_path / "p.fasta")).collect()}
    assert fa == {"p1": "ABCDEFGHKLLLLLLLR", "p2": "LLLLLLLR", "decoy_p1": "GGGGGGGK", "empty": ""}
    tables = read_proteins(spark, str(tmp_path / "p.fasta"), missed_cleavages=0)
    assert {tuple(r) for r in tables.peptide_map.collect()} == {("ABCDEFGHK", "p1, p2"), ("LLLLLLLR", "p1, p2"), ("GGGGGGGK", "decoy_p1")}
    psms = spark.createDataFrame([(1, "K.ABCDEFGHK.L", 3.0, True), (2, "K.LLLLLLLR.L", 4.0, True), (3, "K.GGGGGGGK.L", 2.0, False)], "id long, peptide string, score double, target boolean")
    assert [r["best_peptide"] for r in picked_proteins(psms, tables, "peptide", "score", "target", "id").collect()] == ["K.LLLLLLLR.L"]
    (tmp_path / "d.fasta").write_text(">decoy_p1\nAAAAAAK\n")
    with pytest.raises(ValueError):
        read_proteins(spark, str(tmp_path / "d.fasta"))
    line = fasta_lines(spark.createDataFrame([("p", "A" * 150)], ["protein", "sequence"])).first()["value"]
    assert [len(x) for x in line.split("\n")] == [2, 70, 70, 10]


def test_protein_names_are_split_like_any_packed_field(spark):
    packed = [("P1", "A | B | C"), ("P2", '"A"'), ("P3", "[ A ]"), ("P4", '"decoy_A"'), ("P5", '"D k, type 1"'), ("P6", '"D k, type 2";'), ("P7", '"decoy_D k, type 1"'), ("P8", None), ("P8", " ")]
    psms = spark.createDataFrame([(i, p, float(i), not (x or "").startswith('"decoy_'), x) for i, (p, x) in enumerate(packed)], "id long, peptide string, score double, target boolean, proteins string")
    pairs = proteins.proteins_from_column(psms, "peptide", "proteins")
    assert {tuple(r) for r in pairs.collect()} == {
        ("A", "P1"), ("B", "P1"), ("C", "P1"), ("A", "P2"), ("A", "P3"), ("decoy_A", "P4"), ("D k, type 1", "P5"), ("D k, type 2", "P6"), ("decoy_D k, type 1", "P7")
    }
    picked = picked_proteins(psms, group_proteins(pairs), "peptide", "score", "target", "id", check=False)
    # a comma within a name parts neither groups nor pairs
    assert {(r["protein_group"], r["best_peptide"]) for r in picked.collect()} == {("decoy_A", "P4"), ("D k, type 2", "P6"), ("decoy_D k, type 1", "P7")}


@pytest.mark.parametrize("seed", [4, 5])
def test_protein_groups_as_one_by_one(spark, monkeypatch, seed):
    monkeypatch.setattr(skew, "SHARE_ROWS", 3)  # hot peptides are spread
    rng = np.random.default_rng(seed)
    rows = {(p, x) for p, n, of in zip("zyxwvutsrqponmlkjihg", [8, 6, 5, 4, 3, 3, 2, 2, 1, 1] * 2, [8] * 10 + [12] * 10) for x in rng.choice(of, n, replace=False).astype(str)}
    rows |= {("z1", x) for p, x in rows if p == "z"} | {("a", "0"), ("b", "0"), ("b", "1"), ("c", "11"), ("d", "only"), ("x, y", "1")}
    t = group_proteins(spark.createDataFrame([*sorted(rows), ("a", "0"), (None, "0"), ("e", None)], "protein string, peptide string"))
    sets = {p: {x for q, x in rows if q == p} for p, _ in rows}
    groups = brute.protein_groups(sets)
    assert {(r["founder"], r["protein_group"]) for r in t.names.collect()} == {(f, ", ".join(m)) for f, m in groups.items()}
    of = {x: sorted(f for f in groups if x in sets[f]) for s in sets.values() for x in s}
    assert {tuple(r) for r in t.unique.collect()} == {(x, f[0]) for x, f in of.items() if len(f) == 1}
    assert {tuple(r) for r in t.shared.collect()} == {(x, f) for x, fs in of.items() if len(fs) > 1 for f in fs}
    assert any(len(m) > 2 for m in groups.values())


def test_unmatched_decoys_are_an_error(spark):
    t = group_proteins(spark.createDataFrame([("a", f"P{'A' * i}") for i in range(40)] + [("decoy_a", "PQ")], "protein string, peptide string"))
    rows = [(i, f"P{'A' * i}", 1.0, True) for i in range(38)] + [(50, "PQ", 1.0, False), (51, "PZ", 1.0, False)]
    psms = spark.createDataFrame(rows, "id long, peptide string, score double, target boolean")
    with pytest.raises(ValueError, match="decoys"):
        picked_proteins(psms, t, "peptide", "score", "target", "id")
    assert picked_proteins(psms.where("id <> 51"), t, "peptide", "score", "target", "id").count() == 1
    assert picked_proteins(psms.limit(0), t, "peptide", "score", "target", "id").count() == 0


def test_svm_matches_gradient_zero():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(400, 5)), np.sign(rng.normal(size=400))
    x[:, 0] += y
    for p, n in ((1, 1), (0.1, 10), (10, 0.1)):
        w = fit_local(x, y, p, n)
        a = np.column_stack([x, np.ones(400)])
        slack = np.maximum(0, 1 - y * (a @ w))
        grad = w - 2 * a.T @ (np.where(y > 0, p, n) * y * slack)
        assert np.max(np.abs(grad)) < 1e-3


def test_brew_and_confidence(spark, tmp_path, pin):
    (ds,) = read_pin(spark, pin)
    best = best_features(ds.df, list(ds.roles.features), ds.roles.target, 0.05).first()
    assert best["feature"] == "f1" and best["descending"]
    r = brew(ds, 0.05, 0.05, max_iter=2)
    assert r.used == "model" and r.model_passing >= r.feature_passing and len(r.models) == 3
    flipped = PsmDataset(ds.df.withColumn("f1", -F.col("f1")), ds.roles)
    other = brew(flipped, 0.05, 0.05, max_iter=2)
    a, b = ({x["SpecId"]: x["score"] for x in z.scored.select("SpecId", "score").collect()} for z in (r, other))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6
    save_models(r.models, str(tmp_path / "m.json"))
    assert load_models(str(tmp_path / "m.json")) == r.models
    again = brew(ds, 0.05, 0.05, models=load_models(str(tmp_path / "m.json")))
    assert again.model_passing == r.model_passing
    scored = PsmDataset(r.scored, ds.roles)
    c = assign_confidence(scored, "score", 0.05)
    psms = c.psms.toPandas()
    assert set(c.levels) == {"psms", "peptides", "modifiedpeptides"} and len(psms) == 750 and psms.q_value.between(0, 1).all() and psms.pep.between(0, 1).all()
    assert c.peptides.count() <= 750
    with pytest.raises(ValueError):
        c.read("x")
    streamed = assign_confidence(scored, "score", stream_confidence=True, peps_algorithm="hist_nnls").psms.toPandas()
    both = psms.merge(streamed, on="SpecId")
    assert (both.q_value_x - both.q_value_y).abs().mean() < 0.02
    with pytest.raises(ValueError):
        assign_confidence(scored, "score", stream_confidence=True)
    written = write_confidence(c, str(tmp_path / "out"), write_decoys=True, file_root="x")
    assert spark.read.parquet(written["psms"]["targets"]).count() + spark.read.parquet(written["psms"]["decoys"]).count() == 750


@pytest.mark.skipif(not TABLES.exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", ["brew_scores", "end_to_end"])
def test_registered_rescoring_is_the_whole_training(spark, monkeypatch, name):
    asked = []

    def spy(*args, **options):
        bound = inspect.signature(brew).bind(*args, **options)
        bound.apply_defaults()
        asked.append(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(core_queries, "brew", spy)
    with pytest.raises(InterruptedError):
        core_queries.QUERIES[name](spark, str(TABLES))
    assert [(a["max_iter"], a["search"], a["subset_max_train"], a["models"]) for a in asked] == [(10, True, None, None)]


def test_bad_features_fall_back(spark):
    df = spark.createDataFrame(psm_pandas(600, shift=0.0).drop(columns=["f2", "f3"]))
    with pytest.raises(RuntimeError):
        brew(PsmDataset.of(df), 0.001, 0.001, max_iter=1, search=False)


def test_percolator_weights(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("f1\tf2\tm0\n0.1\t0.2\t0.3\n1.0\t-2.0\t0.5\n")
    (m,) = load_models(str(tmp_path / "w.tsv"))
    assert isinstance(m, LinearModel) and m.weights == (1.0, -2.0) and m.bias == 0.5
    assert spark.createDataFrame([(3.0, 1.0)], ["f1", "f2"]).select(m.score().alias("s")).first()["s"] == 1.5


def test_sqlite_and_flashlfq(spark, tmp_path):
    db = str(tmp_path / "r.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE CANDIDATE (CANDIDATE_ID INTEGER PRIMARY KEY, PSM_FDR REAL, SVM_SCORE REAL, POSTERIOR_ERROR_PROBABILITY REAL)")
        c.execute("CREATE TABLE PEPTIDE_VALIDATION (PEPTIDE_ID INTEGER PRIMARY KEY, FDR REAL, PEP REAL, SVM_SCORE REAL)")
        c.executemany("INSERT INTO CANDIDATE (CANDIDATE_ID) VALUES (?)", [(1,), (2,)])
    df = spark.createDataFrame([(1, 0.1, 5.0, 0.2)], "id long, q_value double, score double, pep double")
    assert write_sqlite(df, db, "psms", "id") == 1 and write_sqlite(df, db, "peptides", "id") == 1
    with sqlite3.connect(db) as c:
        assert c.execute("SELECT * FROM CANDIDATE").fetchall() == [(1, 0.1, 5.0, 0.2), (2, None, None, None)]
        assert c.execute("SELECT PEPTIDE_ID, FDR, PEP, SVM_SCORE FROM PEPTIDE_VALIDATION").fetchall() == [(1, 0.1, 0.2, 5.0)]
    for level in ("proteins", "precursors"):
        with pytest.raises(ValueError):
            write_sqlite(df, db, level, "id")
    src = spark.createDataFrame([("/x/a.mzML", 1, 2.5, 500.0, 2, "K.AB[16]C.R", "p1\tp2"), ("/x/a.mzML", 2, 2.6, 501.0, 2, "D", None)], "filename string, scan long, rt double, mass double, z int, pep string, prot string")
    roles = infer_roles(["id", *src.columns, "label"], peptide="pep", protein="prot", scan="scan", calcmass="mass", rt="rt", charge="z", filename="filename", id="id", target="label")
    acc = src.withColumn("q_value", F.lit(0.001))
    (row,) = to_flashlfq(src, acc, roles).collect()
    assert row["File Name"] == "a.mzML" and row["Base Sequence"] == "ABC" and row["Protein Accession"] == "p1; p2"
    with pytest.raises(ValueError):
        to_flashlfq(src.union(src), acc, roles)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], ["x", "y"])
    write_table(df, str(tmp_path / "o.tsv"), single_file=True)
    assert (tmp_path / "o.tsv").read_text() == "x\ty\n1\ta\n"
    with pytest.raises(FileExistsError):
        write_table(df, str(tmp_path / "o.tsv"), single_file=True)
    assert output_path("d", "psms", "targets", "r", "p", ".tsv") == "d/r.p.targets.psms.tsv" and output_path("d", "psms", "decoys") == "d/decoys.psms.parquet"


def test_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"score": rng.normal(size=500), "target": rng.random(500) < 0.6}))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    start_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "score", "target", -4.0, 4.0, lambda h, n: seen.append(h), str(tmp_path / "cp"), 80).awaitTermination()
    assert sum(seen[-1].targets) == df.where("target").count() and sum(seen[-1].decoys) == df.where("not target").count()
    assert histogram_confidence(df.limit(0), "score", "target").count() == 0


def test_command_line(spark, tmp_path, pin):
    out = str(tmp_path / "o")
    assert cli.main([pin, "-d", out, "--train_fdr", "0.05", "--test_fdr", "0.05", "--max_iter", "1", "--keep_decoys", "--save_models", "--peps_algorithm", "hist_nnls"]) == 0
    assert len(json.load(open(f"{out}/models.json"))) == 3
    t, d = spark.read.parquet(f"{out}/targets.psms.parquet"), spark.read.parquet(f"{out}/decoys.psms.parquet")
    assert t.columns == ["SpecId", "ScanNr", "ExpMass", "Peptide", "ModifiedPeptide", "score", "q_value", "pep", "Proteins"] and t.count() + d.count() == 750
    assert read_results(spark, out, "psm").count() == 750
    assert cli.main(["rollup", "--level", "psm", "--src_dir", out, "--dest_dir", out, "--peps_algorithm", "hist_nnls"]) == 0
    assert spark.read.parquet(f"{out}/rollup.targets.modified_peptides.parquet").count() > 100
    assert cli.main([pin, "--stream_confidence"]) == 250
    assert cli.main([str(tmp_path / "none.pin"), "-d", out]) == 252


def test_joint(spark, pin):
    a, b = read_pin(spark, pin)[0], PsmDataset.of(spark.createDataFrame(psm_pandas(600, 7)))
    x, y = brew_joint([a, b], train_fdr=0.05, test_fdr=0.05, max_iter=1, search=False)
    assert x.scored.count() == 1500 and y.scored.count() == 600
    with pytest.raises(ValueError):
        brew_joint([a, PsmDataset.of(b.df.drop("f3", "_row_id").withColumn("Label", F.when(F.col("Label"), 1).otherwise(-1)))])


def test_other_estimators_and_start_models(spark, pin):
    from pyspark.ml.classification import LogisticRegression

    from peptrail.learn.estimators import MLlibEstimator

    (ds,) = read_pin(spark, pin)
    r = brew(ds, 0.05, 0.05, max_iter=1, estimator=MLlibEstimator(LogisticRegression(maxIter=20)))
    assert r.used == "model" and r.scored.count() == 1500 and set(r.scored.columns) >= {"score", "fold", "f1"}
    good = LinearModel(("f1", "f2", "f3"), (0.0,) * 3, (1.0,) * 3, (1.0, -1.0, 0.0), 0.0)
    started = brew(ds, 0.05, 0.05, max_iter=1, search=False, start_model=good)
    assert len(started.models) == 3 and started.used == "model"
    with pytest.raises(ValueError):
        brew(ds, start_model=LinearModel(("x",), (0.0,), (1.0,), (1.0,), 0.0))


def test_missing_features(spark):
    pdf = psm_pandas(900)
    pdf.loc[::7, "f3"] = np.nan
    ds = PsmDataset.of(spark.createDataFrame(pdf), drop_na_features=False)
    r = brew(ds, 0.05, 0.05, max_iter=1, search=False)
    assert r.used == "model" and r.scored.where("score is null or isnan(score)").count() == 0
