"""Schemas that drift between files: versioned fingerprints, explicit migration steps, one consistent table.

Every file's schema (names, types, value ranges of its valid lines) is one small record. Consecutive records of a series are compared in
order; the differences are migration steps (added, removed, renamed, retyped). The steps of a series, chained, tell the one field that
each of its names stands for, and every file's rows are routed through them: rename, default (null) and cast to the widest type.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peptrail.operators.reject_rows import HUGE_WHOLE, OTHER, WHOLE_KIND, kind_of, load_lines_with_headers
from peptrail.operators.skew import join_checked
from peptrail.session import cut_lineage

_ALL = 2**64 - 1
#: Roles whose columns are the same field under any name; others are matched by name.
IDENTIFIER, PEPTIDE, PROTEINS = "specid", "peptide", "proteins"

_COLUMN = "struct<name:string,type:string,n:bigint,lo:double,hi:double,mean:double,sd:double,bits:bigint>"
_STEPS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("old", "new", "change_kind", "old_type", "new_type")]))


#: Standard errors by which means or spreads of the same field may differ between two files.
NOISE = 3.0


def _bare(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _words(name: str) -> set[str]:
    """Words and numbers of a name, parted by other characters, by digits and by a capital behind a small letter."""
    return set(re.findall(r"[^\W\d_]+|\d+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()))


def _common(p: str, q: str) -> int:
    """Length of the longest piece that both have."""
    return max((n for i in range(len(p)) for n in range(1, len(p) - i + 1) if p[i : i + n] in q), default=0)


def _short_for(a: str, b: str) -> bool:
    """Whether a is b's first word, or a's characters are b's in their order, from the first on, with all digits."""
    p, q = _bare(a), _bare(b)
    if p and re.split(r"[^a-z0-9]+", b.lower())[0] == p:
        return True
    rest = iter(q)
    return len(p) >= 2 and p[0] == q[:1] and all(c in rest for c in p) and re.sub(r"\D", "", p) == re.sub(r"\D", "", q)


def same_name(a: str, b: str) -> float:
    """How much two names speak for one field, 0 to 1: 0.9 one holds the other, 0.7 a short form, 0.6 a word, a number or half of the letters in common."""
    p, q = _bare(a), _bare(b)
    if not p or not q:
        return 0.0
    if p == q or (min(len(p), len(q)) >= 4 and (p in q or q in p)):
        return 0.9
    if _short_for(a, b) or _short_for(b, a):
        return 0.7
    digits = [sorted(re.findall(r"\d+", x)) for x in (a, b)]
    if digits[0] != digits[1] and all(digits):
        return 0.0  # numbered fields of other numbers
    if any(len(w) > 1 or w.isdigit() for w in _words(a) & _words(b)) or _common(p, q) >= 4:
        return 0.6
    pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    return 2 * len(pairs(p) & pairs(q)) / max(1, len(pairs(p)) + len(pairs(q)))


def same_meaning(a: dict, b: dict) -> float:
    """How well two columns in the same place agree in meaning, 0 to 1; above 0.5 they are one field.

    Names of which one holds or shortens the other speak for it, those that have less in common unless the values contradict; values that are distributed alike speak for it whatever
    the names are. That both are text, or both within 0 and 1, is no evidence.
    """
    name = same_name(a["name"], b["name"])
    if (a["type"] == "text") != (b["type"] == "text"):
        return name if name >= 0.7 else 0.0
    values = same_values(a, b)
    if values is None:
        return name
    return max(name if values > 0 or name >= 0.7 else min(name, 0.5), 0.9 * values)


def same_values(a: dict, b: dict) -> float | None:
    """How alike the values of two columns are distributed, 0 to 1; None if what is known of them tells nothing.

    Texts: the share of common values, by a bitmap of 64 hashes, unless it is nearly full. Numbers: the overlap of their ranges, if means
    and spreads differ by no more than chance allows, else 0. Ranges within 0 and 1 tell nothing for a field, but may against it.
    """
    if a["type"] == "text":
        u, v = (c.get("bits") for c in (a, b))
        if u is None or v is None or max((u & _ALL).bit_count(), (v & _ALL).bit_count()) > 40:
            return None
        return (u & v & _ALL).bit_count() / max(1, ((u | v) & _ALL).bit_count())
    if any(c[k] is None for c in (a, b) for k in ("lo", "hi")):
        return None
    wide = max(a["hi"], b["hi"]) - min(a["lo"], b["lo"])
    overlap = (min(a["hi"], b["hi"]) - max(a["lo"], b["lo"])) / wide if wide else 1.0
    if all(c.get(k) is not None for c in (a, b) for k in ("n", "mean", "sd")):
        (m, r, x), (n, t, y) = ((max(1, c["n"]), c["mean"], c["sd"]) for c in (a, b))
        if min(m, n) < 3:
            return None
        few = (0.5 / m + 0.5 / n) ** 0.5
        # one that is constant so far may have been drawn from the other's values
        error = (x * x / m + y * y / n) ** 0.5 if x and y else max(x, y) * 2**0.5 * few
        if abs(r - t) > NOISE * error + 1e-12 * (abs(r) + abs(t)) or (x and y and abs(math.log(x / y)) > NOISE * few):
            return 0.0
        if overlap > 0:
            overlap = max(overlap, 0.6)  # few values reach the ends of a range by chance
    if wide == 0 or all(0 <= c["lo"] and c["hi"] <= 1 for c in (a, b)):
        return None
    return max(0.0, overlap)


def migration(old: list[dict], new: list[dict]) -> list[tuple[str | None, str | None, str, str | None, str | None]]:
    """Steps (old name, new name, kind, old type, new type) that lead from one version to the next; order and case are no change."""
    steps: list[tuple] = []
    pairs: list[tuple[int, int]] = []
    fixed_old, fixed_new = ({0, len(c) - 2} if len(c) > 2 else {0} for c in (old, new))
    pairs.append((0, 0))
    if len(old) > 2 and len(new) > 2:
        pairs.append((len(old) - 2, len(new) - 2))
    at_new: dict[str, int] = {}
    for j, c in enumerate(new):
        if j not in fixed_new:
            at_new.setdefault(c["name"].lower(), j)
    shared: list[tuple[int, int]] = []
    for i, c in enumerate(old):
        if i not in fixed_old and (j := at_new.pop(c["name"].lower(), None)) is not None:
            shared.append((i, j))
    pairs += shared

    def places(columns: list[dict], fixed: set[int], known: set[int]) -> dict[int, tuple[str, str]]:
        """For each unmatched column the nearest matched names on both sides."""
        out, left = {}, "<"
        for k in range(1, len(columns)):
            if k in known:
                left = columns[k]["name"].lower()
            elif k not in fixed:
                out[k] = left
        right = ">"
        for k in range(len(columns) - 1, 0, -1):
            if k in known:
                right = columns[k]["name"].lower()
            elif k in out:
                out[k] = (out[k], right)
        return out

    gone, come = places(old, fixed_old, {i for i, _ in shared}), places(new, fixed_new, {j for _, j in shared})
    options = sorted(((-s, i, j) for i, p in gone.items() for j, q in come.items() if p == q and (s := same_meaning(old[i], new[j])) > 0.5), key=lambda o: o)
    for _, i, j in options:
        if i in gone and j in come:
            pairs.append((i, j))
            del gone[i], come[j]
    for i, j in pairs:
        a, b = old[i], new[j]
        if a["name"].lower() != b["name"].lower():
            steps.append((a["name"], b["name"], "renamed", a["type"], b["type"]))
        if a["type"] and b["type"] and a["type"] != b["type"]:
            steps.append((a["name"], b["name"], "retyped", a["type"], b["type"]))
    steps += [(old[i]["name"], None, "removed", old[i]["type"], None) for i in gone]
    steps += [(None, new[j]["name"], "added", None, new[j]["type"]) for j in come]
    return steps


@F.pandas_udf(_STEPS)
def _migrate(old: pd.Series, new: pd.Series) -> pd.Series:
    names = ("old", "new", "change_kind", "old_type", "new_type")
    return pd.Series([[dict(zip(names, s)) for s in migration(list(a), list(b))] for a, b in zip(old, new)], dtype=object)


def versions(lines: DataFrame, files: DataFrame, clean: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    """(series_id, file_seq, file_id, columns, fingerprint): the schema of every file that has a header; ``clean`` and ``heads``: the valid
    lines and the headers, if known.

    A column's type is the narrowest of whole, decimal and text that fits all its non-empty values in valid lines (whole, if it has none).
    """
    if clean is None or heads is None:
        clean, _, heads = load_lines_with_headers(lines, files)
    cells = clean.select("file_id", F.posexplode("values").alias("no", "v")).where("v <> ''").withColumn("k", kind_of(F.col("v")))
    v, k = F.col("v"), F.col("k")
    number, whole = k != OTHER, k.isin(WHOLE_KIND, HUGE_WHOLE)
    value = F.when(number, v.try_cast("double"))
    kinds = cells.groupBy("file_id", "no").agg(F.min(number).alias("number"), F.min(whole).alias("whole"), F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.expr("bit_or(shiftleft(1L, pmod(hash(v), 64)))").alias("bits"))
    names = heads.select("file_id", F.posexplode("header").alias("no", "name"))
    kind = F.when(F.coalesce("whole", F.lit(True)), "whole").when(F.col("number"), "decimal").otherwise("text")
    column = F.struct("no", F.struct("name", kind.alias("type"), "n", F.when(F.col("number"), F.col("lo")).alias("lo"), *[F.when(F.col("number"), F.col(k)).alias(k) for k in ("hi", "mean", "sd")], "bits").alias("c"))
    # grouped by file: as many entries as its header has columns
    columns = names.join(kinds, ["file_id", "no"], "left").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(column)), lambda s: s["c"]).cast(f"array<{_COLUMN}>").alias("columns"))
    print_of = F.sha2(F.array_join(F.transform("columns", lambda c: F.concat_ws(":", F.lower(c["name"]), c["type"])), "|"), 256)
    known = files.select("file_id", "series_id", "file_seq").dropDuplicates(["file_id"])
    return known.join(columns, "file_id").withColumn("fingerprint", print_of)


def changes(lines: DataFrame, files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(series_id, file_id, field_name, change_kind, old_name, new_name, old_type, new_type): every change from a file to the next.

    Files follow each other by file_seq within their series (by file_id among equals); a null series has no order and no changes. Equal
    fingerprints are passed over. The window streams through a series: it holds two records at a time. ``known``: the versions, if made.
    """
    w = Window.partitionBy("series_id").orderBy("file_seq", "file_id")
    known = versions(lines, files) if known is None else known
    both = known.where("series_id is not null").withColumn("before", F.lag("columns").over(w)).withColumn("print_before", F.lag("fingerprint").over(w))
    moved = both.where("before is not null and fingerprint <> print_before").select("series_id", "file_id", F.inline(_migrate("before", "columns")))
    name = F.when(F.col("change_kind") == "removed", F.col("old")).otherwise(F.col("new"))
    return moved.select("series_id", "file_id", name.alias("field_name"), "change_kind", F.col("old").alias("old_name"), F.col("new").alias("new_name"), "old_type", "new_type")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _chain(steps: pd.Series) -> pd.Series:
    """Renames of a series, as (old, new) in lower case, to the one field that each name stands for."""

    def fold(pairs: list[dict]) -> dict[str, str]:
        up: dict[str, str] = {}

        def root(x: str) -> str:
            while x in up:
                x = up[x]
            return x

        for p in sorted(pairs, key=lambda p: (p["old"], p["new"])):
            a, b = root(p["old"]), root(p["new"])
            if a != b:
                keep, other = sorted((a, b))
                up[other] = keep
        return {n: root(n) for p in pairs for n in (p["old"], p["new"])}

    return pd.Series([fold(list(s)) for s in steps], dtype=object)


def unify(lines: DataFrame, files: DataFrame, fields: list[str] | None = None, most_fields: int = 2_000) -> DataFrame:
    """One consistent table of all files' valid lines: line_id, file_id, specid, label, scannr, expmass, peptide, proteins, then features.

    Names that a series' renames join are one field, called by the one of them that most files have, in lower case; a series that has only
    another of them follows what most series say, unless it has both. Where files differ in type a field has the widest (text as string,
    decimal as double, whole as long); a file without the field has null there. ``fields`` names the wanted features; by default all that
    occur, of which there may be ``most_fields`` (the names of a schema, not data).
    """
    clean, _, heads = load_lines_with_headers(lines, files)
    known = cut_lineage(versions(lines, files, clean, heads))
    fields_of = known.select("series_id", "file_id", F.posexplode("columns").alias("no", "c"), F.size("columns").alias("width")).withColumn("name", F.lower("c.name"))
    renames = changes(lines, files, known).where("change_kind = 'renamed'").select("series_id", F.struct(F.lower("old_name").alias("old"), F.lower("new_name").alias("new")).alias("p"))
    # as many rows as the headers of the series have names
    chains = renames.groupBy("series_id").agg(F.collect_set("p").alias("pairs")).select("series_id", F.explode(_chain("pairs")).alias("name", "root"))
    often = fields_of.groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    common = chains.join(often, "name").groupBy("series_id", "root").agg(F.min_by("name", F.struct(-F.col("files"), "name")).alias("field"))
    own = cut_lineage(chains.join(common, ["series_id", "root"]).select("series_id", "name", F.col("field").alias("own")))
    votes = own.groupBy("name", "own").agg(F.count(F.lit(1)).alias("v")).groupBy("name").agg(F.min_by("own", F.struct(-F.col("v"), "own")).alias("others"))
    called = fields_of.join(own, ["series_id", "name"], "left").join(votes, "name", "left").withColumn("field", F.coalesce("own", "others", "name"))
    # two columns of one file stay two
    twice = F.count(F.lit(1)).over(Window.partitionBy("file_id", "field")) > 1
    place = F.when(F.col("no") == 0, IDENTIFIER).when(F.col("no") == F.col("width") - 1, PROTEINS).when(F.col("no") == F.col("width") - 2, PEPTIDE)
    routed = called.withColumn("field", F.when(twice, F.col("name")).otherwise(F.col("field"))).select("file_id", "no", F.coalesce(place, F.col("field")).alias("field"), F.col("c.type").alias("type"))
    rank = F.when(F.col("type") == "whole", 0).when(F.col("type") == "decimal", 1).otherwise(2)
    widest = {r[0]: r[1] for r in routed.groupBy("field").agg(F.max(rank)).limit(most_fields + 1).collect()}
    if len(widest) > most_fields:
        raise ValueError(f"more than {most_fields} different fields; name the wanted ones")
    base = [IDENTIFIER, "label", "scannr", "expmass", PEPTIDE, PROTEINS]
    features = sorted(set(widest) - set(base)) if fields is None else fields
    routes = routed.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "field"))), lambda s: s["field"]).alias("route"))
    rows = join_checked(clean.select("line_id", "file_id", "values"), cut_lineage(routes), ["file_id"], "line_id", "inner")
    # a name that a file has twice is known by its first column
    rows = rows.withColumn("cell", F.map_from_entries(F.filter(F.arrays_zip("route", "values"), lambda e, i: F.array_position("route", e["route"]) == i + 1)))
    cast = {0: "long", 1: "double", 2: "string"}

    def column(field: str):
        v = F.nullif(F.col("cell")[field], F.lit(""))
        return (v if field in (IDENTIFIER, PEPTIDE, PROTEINS) else v.try_cast(cast[widest.get(field, 2)])).alias(field)

    return rows.select("line_id", "file_id", *[column(f) for f in [*base, *features]])

