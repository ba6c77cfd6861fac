"""Packed fields, hot keys, failing rows, nested records, drifting schemas: brute force and edge cases."""

import random

import brute
import numpy as np
import pytest
from brute import split_packed as brute_split


from pyspark.sql import functions as F

from peptrail.operators.dense_accumulate import accumulate
from peptrail.operators.nested_records import flatten_children, linked_tables, parse_record
from peptrail.operators.packed_values import rule_table, split_packed
from peptrail.operators.reject_rows import load_lines
from peptrail.operators.schema_drift import changes, migration, unify
from peptrail.operators.skew import join_skewed
from peptrail.sources.pin_lines import split_line


def values(spark, fields):
    df = spark.createDataFrame([(i, f, "x") for i, f in enumerate(fields)], "id long, packed string, way string")
    out = {}
    for r in split_packed(df, "packed", ["id"]).orderBy("id", "pos").collect():
        out.setdefault(r["id"], []).append(r["value"])
    return [out.get(i, []) for i in range(len(fields))]


CASES = {
    '"a" | "b, c"': ["a", "b, c"], 'a | "b"': ["a", "b"], ' "a;b" ': ["a;b"], "[A];[B]": ["A", "B"], "(A),(B)": ["A", "B"], "[A;B]": ["A", "B"], "[[A];[B]]": ["A", "B"], '["a]b","c"]': ["a]b", "c"], "A;[B]": ["A", "B"], "[A](x)": ["[A](x)"], "{A; B}": ["A", "B"], "sp|A|B(x);C": ["sp|A|B(x)", "C"], '"[A]";B': ["[A]", "B"],
    "a;b": ["a", "b"], "a": ["a"], " a ; b ;": ["a", "b"], ";;a": ["a"], 'a, "b, c"': ["a", "b, c"], "sp|A|B | sp|C|D": ["sp|A|B", "sp|C|D"], "x\\;y;z": ["x;y", "z"],
    '["a","b"]': ["a", "b"], "{a, b}": ["a", "b"], "5'-x;'y;z'": ["5'-x", "y;z"], '"a ""k"" 3"\tb': ['a "k" 3', "b"], '"a \\"k\\" 3"': ['a "k" 3'], "": [], "  ": [], "a;a": ["a", "a"],
    'a"b;c': ['a"b', "c"], "a:b\tc": ["a", "b", "c"],
}


def test_packed_cases(spark):
    assert values(spark, list(CASES)) == list(CASES.values())
    assert values(spark, [None, "a"]) == [[], ["a"]]


def test_packed_brute_force(spark):
    rng = random.Random(4)
    fields = ["".join(rng.choice(["a", "b", "|", " ", ";", ",", ":", "\t", '"', "'", "\\", "[", "]", " | "]) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    fields += [";".join(["x" * 50] * 5_000), '"' + 'q""' * 20_000 + '"']
    wrong = [(f[:80], got[:9], want[:9]) for f, got in zip(fields, values(spark, fields)) if got != (want := brute_split(f))]
    assert not wrong


def test_packed_bounds_and_names(spark):
    assert rule_table(spark).count() == 2**7
    df = spark.createDataFrame([(1, "a;b")], "pos long, packed string")
    with pytest.raises(ValueError):
        split_packed(df, "packed", ["pos"])
    assert split_packed(df.limit(0), "packed", []).count() == 0


def test_accumulate_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.integers(0, 50)}", float(rng.integers(0, 5))) for i in range(3000)]
    rows += [(9001, None, 1.0), (9002, "", 2.0), (9003, "n", None), (9004, "m", float("nan")), (9005, " ", 1.0)]
    df = spark.createDataFrame(rows, "row_id long, key string, score double").withColumn("k", F.lit(1)).withColumn("s", F.lit("clash"))
    expected = {}
    for i, k, s in rows:
        if k is not None and s is not None and s == s:
            b = expected.setdefault(k, [s, i, 0])
            b[2] += 1
            if (s, -i) > (b[0], -b[1]):
                b[0], b[1] = s, i
    got = {r["key"]: [r["best_score"], r["row_id"], r["n"]] for r in accumulate(df.repartition(7), "key", "score", "row_id").collect()}
    assert got == expected
    assert accumulate(df.limit(0), "key", "score", "row_id").count() == 0


def test_accumulate_flushes(spark, monkeypatch):
    from peptrail.operators import dense_accumulate

    monkeypatch.setattr(dense_accumulate, "FLUSH_ENTRIES", 3)
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 11).cast("string").alias("key"), (F.col("id") % 7).cast("double").alias("score"))
    assert {r["key"]: r["n"] for r in accumulate(df, "key", "score", "row_id").collect()} == {str(k): len(range(k, 500, 11)) for k in range(11)}


def test_join_skewed(spark):
    big = spark.range(1000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10).alias("key"))
    small = spark.createDataFrame([(k, f"v{k}") for k in range(8)], "key long, v string")
    for how in ("left", "inner"):
        a = sorted(map(tuple, join_skewed(big, small, "key", "row", how, share_rows=20).select("row", "key", "v").collect()), key=str)
        assert a == sorted(map(tuple, big.join(small, "key", how).select("row", "key", "v").collect()), key=str)


def test_split_line(spark):
    rng = random.Random(3)
    lines = ['a, "b, c" ,d', 'a,"b""c"', 'a,b"c', "a,", 'a,"b', 'a,"b"c', '"', "a\t\t b", "", " ", '"a" \t"b"\t', '"a"x', "," * 5000, '"' + '""' * 20000 + '"', '"x' * 3, ' "a",\t"b" ', '"",', '""']
    lines += ["".join(rng.choice('ab", \t\u3000"') for _ in range(rng.randint(0, 14))) for _ in range(600)]
    rows = [(i, s, t) for i, t in enumerate(lines) for s in ",\t"]
    df = spark.createDataFrame(rows, "i int, s string, t string").select("i", "s", split_line(F.col("t"), F.col("s")).alias("v"))
    assert {(r["i"], r["s"]): r["v"] for r in df.collect()} == {(i, s): brute.split_line(t, s) for i, s, t in rows}


FILES = [(1, 1, 1, "a_1.pin"), (2, 1, 2, "a_2.csv"), (3, 1, 3, "a_3.tab"), (4, None, 1, "b.pin")]
LINES = {
    1: ["# c", "﻿SpecId\tLabel\tScanNr\tExpMass\tXcorr\ttag\tPeptide\tProteins\r", "s1\t1\t5\t100.5\t2\teng-a\tK.A.R\tp1\tp2\r", "s2\t-1\t6\t1e2\t\teng-b\tK.B.R\t\"p1\"", "", "s3\t1\t7\t100\tabc\teng\tK.C.R\tp", "s4\t1\t7\t100\t1\teng\tK.C.R\t",
        "s5\t1\t7\t100\t1\teng\tK.C.R\t\"p", "s6\t1\t7", "DefaultDirection\t-\t-\t-\t0\t0\t-\t-", "SpecId\tLabel\tScanNr\tExpMass\tXcorr\ttag\tPeptide\tProteins", "s 7\t1\t7\t100\t1\teng\tK\tp", "s8\t0\t7\t100\t1\teng\tK\tp", "s9\t1\t+7\t100\t1\teng\tK\tp", "t1\t1\t7\t0\t1\teng\tK\tp", "t2\t1\t7\tinf\t1\teng\tK\tp", "NA\t1\t7\t1\t1\teng\tK\tp", "t3\t1\t7\t1\t1e999\teng\tK\tp"],
    2: ["PSMId,Label,ScanNr,ExpMass,cross_corr,tag,new,Peptide,Proteins", 'u1,1,5,100.5,2.5,eng-a,7,K.A.R,"p1,p2"', "u2,1,5,100.5,2.5,eng-a,7,K.A.R,p1,p2", "u3,-1,5,9,1,x,0,K,null"],
    3: ["psmid\tLabel\tScanNr\tExpMass\tXCORR\tnew\tPeptide\tProteins", "1\t1\t5\t100.5\t2\tword\tK\tp"],
    4: [],
}


def pin_frames(spark):
    lines = [(f * 100 + n, f, n, t) for f, ts in LINES.items() for n, t in enumerate(ts, 1)]
    return spark.createDataFrame(lines, "line_id long, file_id long, line_no int, line_text string"), spark.createDataFrame(FILES, "file_id long, series_id long, file_seq int, file_name string")


def test_load_lines(spark):
    clean, rejected = load_lines(*pin_frames(spark))
    reasons = {r["line_id"]: r["reason"] for r in rejected.collect()}
    assert reasons == {106: "invalid_value", 107: "invalid_value", 108: "broken_quote", 109: "column_count", **{k: "invalid_value" for k in range(112, 119)}, 203: "column_count", 204: "invalid_value"}
    rows = {r["line_id"]: r["values"] for r in clean.collect()}
    assert set(rows) == {103, 104, 202, 302}
    assert rows[103][-1] == "p1\tp2" and rows[202][-1] == "p1,p2" and rows[104][4] == ""


def test_load_lines_of_nothing(spark):
    lines, files = pin_frames(spark)
    assert load_lines(lines.limit(0), files)[1].count() == 0
    assert load_lines(lines, files.limit(0))[1].count() >= 0


def test_changes(spark):
    got = {(r["file_id"], r["field_name"], r["change_kind"]) for r in changes(*pin_frames(spark)).collect()}
    assert got == {
        (2, "PSMId", "renamed"), (2, "cross_corr", "renamed"), (2, "cross_corr", "retyped"), (2, "new", "added"), (3, "psmid", "retyped"), (3, "XCORR", "renamed"), (3, "XCORR", "retyped"), (3, "tag", "removed"), (3, "new", "retyped"),
    }


def test_unify(spark):
    df = unify(*pin_frames(spark))
    assert {"specid", "label", "scannr", "expmass", "peptide", "proteins", "xcorr", "new", "tag"} <= set(df.columns)
    rows = {r["line_id"]: r for r in df.collect()}
    assert rows[202]["xcorr"] == 2.5 and rows[302]["xcorr"] == 2.0 and rows[103]["new"] is None and rows[302]["new"] == "word" and rows[302]["specid"] == "1"


def col(name, kind="decimal", lo=0.0, hi=1.0):
    return {"name": name, "type": kind, "lo": lo, "hi": hi}


def test_migration():
    ends = [col("Peptide", "text"), col("Proteins", "text")]
    head = [col("SpecId", "text")]
    base = [*head, col("a"), col("lnrSp"), col("c"), *ends]
    assert migration(base, [base[0], base[3], base[2], base[1], *ends]) == []
    assert [s[2] for s in migration(base, [*head, col("A"), col("ln_r_sp"), col("c"), *ends])] == ["renamed"]
    # another meaning in the same place
    assert sorted(s[2] for s in migration(base, [*head, col("a"), col("cross_corr"), col("c"), *ends])) == ["added", "removed"]
    # unknown names: value ranges decide
    assert [s[2] for s in migration([*head, col("qqq", lo=3, hi=9), *ends], [*head, col("zzz", lo=3.1, hi=8.9), *ends])] == ["renamed"]
    assert sorted(s[2] for s in migration([*head, col("qqq", lo=3, hi=9), *ends], [*head, col("zzz", lo=100, hi=900), *ends])) == ["added", "removed"]


def test_migration_of_unknown_names():
    ends, head = [col("Peptide", "text"), col("Proteins", "text")], [col("SpecId", "text")]
    kinds = lambda a, b: sorted(s[2] for s in migration([*head, a, *ends], [*head, b, *ends]))
    apart = ["added", "removed"]
    # type, or a range of 0 and 1, is no evidence
    assert kinds(col("is_decoyish", "whole", 0, 1), col("zflag", "whole", 0, 1)) == apart
    assert kinds(col("qqq", "text", None, None), col("zzz", "text", None, None)) == apart
    assert kinds(col("qqq", "text", None, None) | {"bits": 0b0111}, col("zzz", "text", None, None) | {"bits": 0b111000}) == apart
    assert kinds(col("qqq", "text", None, None) | {"bits": 0b0111}, col("zzz", "text", None, None) | {"bits": 0b0111}) == ["renamed"]
    # the same range, but not the same distribution
    assert kinds(col("qqq", lo=3, hi=9) | {"n": 50, "mean": 4.0, "sd": 0.5}, col("zzz", lo=3, hi=9) | {"n": 50, "mean": 8.0, "sd": 0.5}) == apart
    assert kinds(col("qqq", lo=3, hi=9) | {"n": 50, "mean": 6.0, "sd": 1.0}, col("zzz", lo=3, hi=9.1) | {"n": 50, "mean": 6.1, "sd": 1.1}) == ["renamed"]
    assert kinds(col("ab12_feature_3", lo=3, hi=9), col("ab12_f3", lo=4, hi=12)) == ["renamed"]


def test_renames_of_unseen_names():
    """Columns drawn anew from the same source under another name, or replaced by others in the same place; names are in no list."""
    rng, words = np.random.default_rng(8), ["velm", "tarbo", "quist", "ondra", "pelk", "shurn", "miva", "dalto", "fengu", "rosk"]

    def column(name, source):
        kind, at, wide = source
        v = rng.normal(at, wide, 60) if kind == "n" else rng.poisson(at, 60) * 1.0 if kind == "p" else rng.lognormal(np.log(abs(at) + 1), 0.7, 60)
        return {"name": name, "type": "whole" if kind == "p" else "decimal", "n": 60, "lo": v.min(), "hi": v.max(), "mean": v.mean(), "sd": v.std(), "bits": None}

    def source():
        return rng.choice(["n", "p", "l"]), float(10.0 ** rng.uniform(0, 3)), float(10.0 ** rng.uniform(-1, 2))

    ends, head, renamed, apart, n = [col("Peptide", "text"), col("Proteins", "text")], [col("SpecId", "text")], 0, 0, 300
    for _ in range(n):
        a, b, c, d = rng.choice(words, 4, replace=False)
        one, other = source(), source()
        new = f"{c}_{d}" if rng.random() < 0.5 else f"{a}{c.title()}"
        renamed += [s[2] for s in migration([*head, column(f"{a}_{b}", one), *ends], [*head, column(new, one), *ends])] == ["renamed"]
        apart += sorted(s[2] for s in migration([*head, column(f"{a}_{b}", one), *ends], [*head, column(f"{c}_{d}", other), *ends])) == ["added", "removed"]
    assert renamed >= 0.9 * n and apart >= 0.9 * n, (renamed, apart)


XML = """<?xml version="1.0" encoding="ISO-8859-1"?><x:spectrum_query xmlns:x="u" spectrum='a &amp; b'><x:search_result/><x:search_result>
<x:search_hit peptide="AB"><x:search_score name="s" value="1"/><x:modification_info><x:mod_aminoacid_mass mass="5.0"/></x:modification_info><x:alternative_protein/>
<x:a><x:b><x:parameter value="&lt;é"/></x:b></x:a></x:search_hit><x:search_hit/></x:search_result></x:spectrum_query>"""


def test_nested_records(spark):
    df = spark.createDataFrame([(1, XML), (2, None), (3, "<broken"), (4, "  "), (5, "<spectrum_query/>"), (1, XML)], "query_id long, xml string").withColumn("record", F.lit(1))
    rows = sorted(map(tuple, flatten_children(df, "query_id", "xml").collect()))
    one = [(1, 2, 1, "alternative", 1, ""), (1, 2, 1, "hit", 0, "AB"), (1, 2, 1, "modification", 1, "5.0"), (1, 2, 1, "parameter", 1, "<é"), (1, 2, 1, "score", 1, "1"), (1, 2, 2, "hit", 0, "")]
    assert rows == sorted(one * 2)
    tables = linked_tables(df, "query_id", "xml")
    assert tables["query"].count() == 6 and tables["hit"].count() == 4 and tables["score"].count() == 2
    assert parse_record("<a/>")["results"] == []
