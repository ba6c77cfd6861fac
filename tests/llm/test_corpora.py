"""Packing, mixing, sentence boundaries: invariants, brute force, edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peptrail.llm.boundary_machine import CUT, INITIAL, NEXT, STATES, compose_scan
from peptrail.llm.boundary_rules import FULL, FULL_RULES, PERIOD, PERIOD_RULES, SHOUT, SHOUT_RULES, compile_rules
from peptrail.llm.mixing import demand, mixture
from peptrail.llm.packing import pack, packed, usage
from peptrail.llm.sentences import sentence_units, text_units
from peptrail.llm.tokens import count_tokens

SENTENCES = [
    ("See U.S. Pat. Appl. No. 13-50a by Veltuva et al. for a similar flexible valve. It moves.", ["See U.S. Pat. Appl. No. 13-50a by Veltuva et al. for a similar flexible valve.", "It moves."]),
    ('The display reads "Stop. Open the sleeve." and the piston is released.Is it free?', ['The display reads "Stop. Open the sleeve." and the piston is released.', "Is it free?"]),
    ('The label says: "Do not heat." The valve opens.', ['The label says: "Do not heat."', "The valve opens."]),
    ("(See Fig. 5.) (See also Table 6.) pH 7.5 is kept for 3 min. mRNA carriers pass.", ["(See Fig. 5.)", "(See also Table 6.)", "pH 7.5 is kept for 3 min.", "mRNA carriers pass."]),
    ("Title No. 3\n\nJ. R. Velbel described it at 5 p.m. on the\nvalve at 17 in. wide. Next", ["Title No. 3", "J. R. Velbel described it at 5 p.m. on the\nvalve at 17 in. wide.", "Next"]),
    ("Claims\n\n1. A kit of claim 2, cf. FIG. 4. The end. 2) The kit: a; box. 3. More", ["Claims", "1. A kit of claim 2, cf. FIG. 4. The end.", "2) The kit: a; box.", "3. More"]),
    ("Am 12. Mai 2023 blieb sie in der 2. Stellung, d. h. im 17. Kapitel. Vgl. Abs. 2 der o. g. Schrift.", ["Am 12. Mai 2023 blieb sie in der 2. Stellung, d. h. im 17. Kapitel.", "Vgl. Abs. 2 der o. g. Schrift."]),
    ("L'écran affiche « Arrêt. Ouvrir. » puis libère. La pression est d'env. 5 mm. Fin !", ["L'écran affiche « Arrêt. Ouvrir. » puis libère.", "La pression est d'env. 5 mm.", "Fin !"]),
    ("如图3所示，角度为36.56度。该活塞(见图17。)宽度为62.75kPa。显示“停止。打开。”字样，随后释放。", ["如图3所示，角度为36.56度。", "该活塞(见图17。)宽度为62.75kPa。", "显示“停止。打开。”字样，随后释放。"]),
    ("『弾性バルブ。』と題する文献No. 1がある。動くか？……その後、閉じる。", ["『弾性バルブ。』と題する文献No. 1がある。", "動くか？", "……その後、閉じる。"]),
    ("यह छड़ है। डॉ. Oxemosk ने बताई। क्या टूट सकती है?", ["यह छड़ है।", "डॉ. Oxemosk ने बताई।", "क्या टूट सकती है?"]),
    ("ต้องไม่ให้ความร้อน แผ่นถอดได้ 16' เชื่อมต่อกับขั้วไฟฟ้า  หาก M3O . 4NaM ให้ปิด", ["ต้องไม่ให้ความร้อน", "แผ่นถอดได้ 16' เชื่อมต่อกับขั้วไฟฟ้า", "หาก M3O . 4NaM ให้ปิด"]),
    ("In 3 Fällen gilt C6H19.5O?N6 und (E + 4.55 / q_4, also fest. Dann {c : c > .28} hier.", ["In 3 Fällen gilt C6H19.5O?N6 und (E + 4.55 / q_4, also fest.", "Dann {c : c > .28} hier."]),
    (" \n\t", []),
    ("", []),
]


@pytest.mark.parametrize("text, expected", SENTENCES)
def test_sentences(text, expected):
    assert [text[a:b] for a, b in text_units(text)] == expected


def noise(seed, n):
    rng = random.Random(seed)
    pieces = ["Fig. 3", ". ", ".", "! ", "? ", " (", ")", '"', " “", "” ", "«", "»", "\n\n", "\n", "1. ", "2) ", "Abc ", "def ", "e.g. ", "停止", "。", "「", "」", "ไทย", " ", "12.5 ", "[", "]", "……", "No. "]
    return "".join(rng.choice(pieces) for _ in range(n))


@pytest.mark.parametrize("seed", range(8))
def test_chunks_and_coverage(seed):
    text = noise(seed, 1200)
    whole = text_units(text)
    assert "".join(text[a:b] for a, b in whole).split() and "".join("".join(text[a:b] for a, b in whole).split()) == "".join(text.split())
    assert all(text[a:b] == text[a:b].strip() for a, b in whole) and all(b <= c for (_, b), (c, _) in zip(whole, whole[1:]))
    for chunk in (97, 501, 1999):
        assert text_units(text, chunk) == whole


RUNS = st.sampled_from([" ", "\n", "\n ", ")", "”", ".", "!", "…", "1", "1.", "(", "“", '"', "。", "ไ", " »", "A", "a", "阀", "²"])
WORDS = st.sampled_from(["Abc", "def", ". ", ".", "! ", "\n\n", "\n", " ", "1. ", "2) ", "(", ")", '"', " “", "” ", "Fig. ", "e.g. ", "停止", "。", "「", "」", "ไทย ", "12.5 ", "U.S. ", "[", "] ", "х. ", "mm. ", "α-", "【請求項1】"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(WORDS, st.tuples(RUNS, st.sampled_from([1, 3, 100, 400, 1000, 5000])).map(lambda r: r[0] * r[1])), max_size=40), st.integers(1, 600))
def test_units_dont_depend_on_chunks(pieces, chunk):
    text = "".join(pieces)
    whole = text_units(text)
    assert text_units(text, chunk) == whole
    assert "".join("".join(text[a:b] for a, b in whole).split()) == "".join(text.split())


def test_long_runs():
    far = "Abc def." + " " * 3000 + "Next one."
    assert [far[a:b] for a, b in text_units(far)] == ["Abc def.", "Next one."]
    text = "Abc (def." + ")" * 2000 + " Next. B"
    assert text_units(text, 500) == text_units(text)
    thai = "ไทย" + " " * 3000 + "ไทย"
    assert len(text_units(thai, 500)) == 2


def test_rules_cover_all_classes():
    for features, rules in ((FULL, FULL_RULES), (SHOUT, SHOUT_RULES), (PERIOD, PERIOD_RULES)):
        table, weights = compile_rules(features, rules)
        assert len(table) == np.prod([len(v) for v in features.values()])
        rng = random.Random(5)
        for _ in range(500):
            pick = {name: rng.choice(list(values)) for name, values in features.items()}
            first = next(outcome for conditions, outcome in rules if all(pick[n] in v for n, v in conditions.items()))
            assert table[sum(weights[n][v] for n, v in pick.items())] == first
        assert all(set(v) <= set(features[n]) for conditions, _ in rules for n, v in conditions.items())


def test_machine_is_total_and_scan_composes():
    assert NEXT.min() >= 0 and NEXT.max() < STATES and CUT[INITIAL].any()
    rng = np.random.default_rng(0)
    f = rng.integers(0, STATES, (37, STATES))
    scan, run = compose_scan(f), np.arange(STATES)
    for k in range(37):
        run = f[k][run]
        assert np.array_equal(scan[k], run)


def test_sentence_units_in_spark(spark):
    texts = [t for t, _ in SENTENCES] + [None, noise(9, 3000), "x" * 5000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").withColumn("row", F.lit(1))
    got = sorted(map(tuple, sentence_units(df, chunk=700).collect()))
    assert got == sorted((i, a, b) for i, t, _ in rows if t for a, b in text_units(t))
    assert sentence_units(df.limit(0)).count() == 0


def test_pack_is_tight_and_keeps_conflicts_apart():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(2000)]
    clusters = [rng.randint(0, 1500) for _ in sizes]
    sources = [rng.choice(["a", "b", "c", None]) for _ in sizes]
    bins, met = pack(sizes, 100, sources, clusters)
    assert sorted(i for b in bins for i in b) == list(range(2000))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 1.03 * sum(sizes) / 100
    assert sum(len(b) - len({clusters[i] for i in b}) for b in bins) == len(met) < 20
    strict, met = pack([50] * 10, 100, ["a"] * 5 + ["b"] * 5, list(range(10)), [("a", "b")])
    assert sum(len({i < 5 for i in b}) > 1 for b in strict) == len(met) <= 1


def test_pack_accepts_conflicts_only_for_fewer_bins():
    bins, met = pack([10] * 300, 100, [None] * 300, [1] * 300)
    assert len(bins) == 30 and len(met) == 270
    # two of a cluster stay apart where that costs nothing
    bins, met = pack([10] * 40, 100, [None] * 40, [1, 2] + list(range(10, 48)))
    assert len(bins) == 4 and not met
    assert pack([60, 60], 100, [None] * 2, [1, 1]) == ([[0], [1]], set())
    assert pack([], 100, [], []) == ([], set())


@pytest.mark.parametrize("seed", range(6))
def test_marked_items_are_those_that_meet(seed):
    rng = random.Random(seed)
    sizes, clusters = [rng.randint(1, 60) for _ in range(300)], [rng.choice([1, 1, rng.randint(2, 60)]) for _ in range(300)]
    sources = [rng.choice("ab") for _ in sizes]
    bins, met = pack(sizes, 100, sources, clusters, [("a", "b")])
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    for b in bins:
        for n, i in enumerate(b):
            assert (i in met) == any(clusters[j] == clusters[i] or sources[j] != sources[i] for j in b[:n])


@pytest.mark.parametrize("block", [1, 7, 50])
def test_pieces_have_the_tokens_of_the_whole(block):
    for text in [t for t, _ in SENTENCES] + [noise(3, 400), "it's 5's  'll\n\n 'x' don't12's", "   a  \n b", "阀门12，压力", "a" * 300, "'s's's", "\u0301e\u0301 \u0301"]:
        assert count_tokens(text, block=block) == count_tokens(text)


def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["valve", "piston", "阀", "клапан"]) for _ in range(rng.randint(1, 400))), rng.choice(["A-b", "a_b", "c", " C ", None, "d"]), rng.randint(1, 40)) for i in range(300)]
    rows += [(900, None, "c", 1), (901, "", "c", None), (902, " ", "c", None), (903, "word " * 3000, "c", None), (903, "word " * 3000, "c", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, family_id long").withColumn("container", F.lit(0))


def test_packed(spark):
    caps = spark.createDataFrame([(1, 256), (2, 1000), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    d = docs(spark)
    p = packed(d, caps, shard_items=100).toPandas()
    texts = [r["text"] for r in d.collect()]
    assert p.groupby("capacity_id").n_tokens.sum().to_dict() == {k: sum(map(count_tokens, texts)) for k in (1, 2)}
    fill = p.groupby(["capacity_id", "container"]).agg(t=("n_tokens", "sum"), cap=("capacity_tokens", "first"))
    assert (fill.t <= fill.cap).all()
    sizes = {r["doc_id"]: count_tokens(r["text"]) for r in d.collect()}
    for (c, i), g in p.groupby(["capacity_id", "doc_id"]):
        if sizes[i] <= {1: 256, 2: 1000}[c]:
            assert len(g) == 1
    u = {r["capacity_id"]: r["unused_share"] for r in usage(packed(d, caps)).collect()}
    assert u[1] < 0.1 and u[2] < 0.1
    assert packed(d.limit(0), caps).count() == 0 and packed(d, caps.limit(0)).count() == 0


def test_demand():
    d = demand({"a": 3, "b": 1, "c": 5}, {"a": 1000, "b": 1000}, {"a": 1, "b": 1, "c": 9}, 1000)
    assert set(d) == {"a", "b"} and abs(d["a"][-1] - 750) < 1e-6 and abs(d["b"][-1] - 250) < 1e-6
    d = demand({"a": 3, "b": 1}, {"a": 100, "b": 1000}, {"a": 2, "b": 1}, 1000)
    assert d["a"][-1] == 200 and abs(d["b"][-1] - 800) < 1e-6
    late = demand({"a": 1, "b": 1}, {"a": 1000, "b": 1000}, {"a": 1, "b": 1}, 1000, {"a": [(0, 0), (1, 1)], "b": [(0, 0)]})
    assert abs(late["a"][512] - 125) < 1 and late["a"][-1] == 500 and abs(late["b"][256] - 125) < 1e-6
    assert demand({}, {}, {}, 10) == {}


def test_a_long_document_doesnt_end_a_share(spark):
    rows = [(i, "valve " * n, "a") for i, n in enumerate([3000, 2500, 2000] + [rng for rng in range(20, 120)])] + [(500 + i, "piston " * 50, "b") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, weight double, max_repeats int")
    for seed in range(3):
        uses, shares = mixture(d, targets, 8_000, seed=seed)
        for r in shares.collect():
            assert abs(r["used_tokens"] - 4_000) <= 70, (seed, r)
        assert not uses.toPandas().duplicated(["doc_id", "copy"]).any()


def test_mixture(spark):
    targets = spark.createDataFrame([("a_b", 0.5, 3), ("c", 0.25, 1), ("d", 0.25, 2), ("nothing", 0.7, 2)], "source string, weight double, max_repeats int")
    d = docs(spark).where("doc_id < 900")
    uses, shares = mixture(d, targets, 12_000)
    s = {r["source"]: r for r in shares.collect()}
    assert s["nothing"]["used_tokens"] == 0 and abs(s["a_b"]["target_share"] - 0.5) < 1e-9
    for name in ("a_b", "c", "d"):
        r = s[name]
        assert r["max_copies"] <= r["max_repeats"]
        assert abs(r["actual_share"] - r["target_share"]) < 0.03 or r["used_tokens"] == r["available_tokens"] * r["max_repeats"]
    u = uses.toPandas()
    assert u.position.is_monotonic_increasing and u.position.between(0, 1).all() and not u.duplicated(["doc_id", "copy"]).any()
    first = u[u.position < 0.5].groupby("source").n_tokens.sum() / u[u.position < 0.5].n_tokens.sum()
    assert abs(first["a_b"] - s["a_b"]["actual_share"]) < 0.08
    # the shares don't depend on the schedules, the positions do
    late, same = mixture(d, targets, 12_000, {"c": [(0, 0), (0.5, 0), (1, 1)]})
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, shares.collect()))
    at = late.toPandas().query("source == 'c'").sort_values("position")
    assert len(at) and at.position.min() >= 0.5 and not at.duplicated(["doc_id", "copy"]).any()
    begins = at.n_tokens.cumsum() - at.n_tokens
    assert abs(at.position - (0.5 + 0.5 * (begins / s["c"]["used_tokens"]) ** 0.5)).max() < 0.05
    empty, none = mixture(d.limit(0), targets)
    assert empty.count() == 0 and none.count() == 4
    assert mixture(d, targets.limit(0))[0].count() == 0
