"""Several values packed in one field: delimiter skeletons, one splitting rule a skeleton, positional extraction.

A field's skeleton is what is left of it when ordinary characters are masked: which delimiters stand outside protected stretches,
whether values are quoted, whether escapes occur and whether the whole field is enclosed in brackets (a bracket that is closed before the
end encloses a value, not the field). The alphabet is closed (see
SYMBOLS), so there are at most ``len(WRAPS) * 2 ** len(SYMBOLS)`` skeletons whatever the data are: the table of rules is resolved for
all of them in advance, and its broadcast has a proven bound. Extraction then picks the cheapest exact way that the rule allows.
Everything stays in the JVM; the only data that move are the output rows.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The delimiters between values (the bar counts only with a blank or an end on both sides) and the enclosing brackets.
DELIMITERS = {"T": r"\t", "C": ":", "S": ";", "K": ",", "B": r"(?:(?<=\s)|(?<=^))\|(?=\s|$)"}
WRAPS = {"-": ("", ""), "[": ("[", "]"), "{": ("{", "}"), "(": ("(", ")"), "<": ("<", ">")}

#: T C S K B: delimiters; Q: a quoted value; E: a protected character.
SYMBOLS = "TCSKBQE"
BLANKS = " \t\r\n\f\u000b ﻿"

_DELIMITER = f"(?:[\\t:;,]|{DELIMITERS['B']})"
#: Possessive throughout: no backtracking, and Java needs no stack that grows with the text.
_DOUBLE, _SINGLE = r'"(?:[^"\\]++|\\.|"")*+"', r"'(?:[^'\\]++|\\.|'')*+'"
_QUOTED = f"{_DOUBLE}|{_SINGLE}"
_ENDS = rf"(?=\s*(?:{_DELIMITER}|$))"
#: A value begins at the start or after a delimiter; a quote that begins it protects up to its closing quote.
_VALUE = rf"(?s)\G\s*((?:{_QUOTED}){_ENDS}|(?:\\.|(?!{_DELIMITER}).)*+)\s*(?:{_DELIMITER}|$)"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _closes_early(a: str, b: str) -> str:
    """What an enclosed text begins with if its first bracket is closed before its end, brackets in quotes, escaped or in pairs aside."""
    a, b = re.escape(a), re.escape(b)
    plain = rf"{_QUOTED}|\\.|[^{a}{b}]"
    return rf"(?s)^(?:{plain}|{a}(?:{plain}|{a}[^{a}{b}]*+{b})*+{b})*+{b}"


def _wrap(body: Column) -> Column:
    """The bracket that encloses the whole field, or '-'."""
    kind, inner = F.lit("-"), F.substring(body, F.lit(2), F.length(body) - 2)
    for k, (a, b) in WRAPS.items():
        if a:
            kind = F.when(body.startswith(a) & body.endswith(b) & (F.length(body) > 1) & ~inner.rlike(_closes_early(a, b)), F.lit(k)).otherwise(kind)
    return kind


def _unwrap(value: Column) -> Column:
    """A value without the brackets around it, if it has any."""
    out = value
    for a, b in list(WRAPS.values())[1:]:
        inner = F.substring(value, F.lit(2), F.length(value) - 2)
        out = F.when(value.startswith(a) & value.endswith(b) & (F.length(value) > 1) & ~F.contains(inner, F.lit(a)) & ~F.contains(inner, F.lit(b)), _trim(inner)).otherwise(out)
    return out


def skeleton(body: Column) -> Column:
    """The symbols that occur in a field without its brackets, in the order of SYMBOLS."""
    plain = ~body.rlike(r"""["'\\]""")
    bare = F.when(plain, body).otherwise(
        F.regexp_replace(
            F.regexp_replace(body, rf"(?s)((?:^|[\t:;,]|(?<=\s)\|(?=\s))\s*)(?:{_QUOTED}){_ENDS}", "$1\u0001"), r"(?s)\\.", "\u0002"
        )
    )
    parts = [F.when(bare.rlike(DELIMITERS[s]), F.lit(s)).otherwise("") for s in DELIMITERS]
    parts += [F.when(bare.contains(mark), F.lit(s)).otherwise("") for s, mark in (("Q", "\u0001"), ("E", "\u0002"))]
    return F.concat(*parts)


def resolve(symbols: str) -> str:
    """The way of splitting for one skeleton: 'single' value, the one delimiter that occurs, 'mixed' delimiters without protection, one 'quoted'
    value, or 'scan' where delimiters and protection meet."""
    if not symbols:
        return "single"
    if set(symbols) <= set(DELIMITERS):
        return symbols if len(symbols) == 1 else "mixed"
    return "quoted" if symbols == "Q" else "scan"


def rule_table(spark: SparkSession) -> DataFrame:
    """(skeleton, way) of every skeleton there can be: 2 ** 7 rows, always."""
    every = ["".join(c) for n in range(len(SYMBOLS) + 1) for c in combinations(SYMBOLS, n)]
    return spark.createDataFrame([(s, resolve(s)) for s in every], "skeleton string, way string")


def _unprotect(token: Column) -> Column:
    """A value without its quotes and escapes."""
    token = _trim(token)
    body = F.substring(token, F.lit(2), F.length(token) - F.lit(2))
    long = F.length(token) > 1
    double = long & token.rlike(f"(?s)^{_DOUBLE}$")
    single = long & token.rlike(f"(?s)^{_SINGLE}$")
    token = F.when(double | single, token).otherwise(_unwrap(token))
    text = F.when(double, F.replace(body, F.lit('""'), F.lit('"'))).when(single, F.replace(body, F.lit("''"), F.lit("'"))).otherwise(token)
    return _trim(F.when(text.contains("\\"), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text))


def split_packed(df: DataFrame, field: str, keep: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per value packed in ``field``, with its position from 1, beside the columns ``keep``.

    Null, empty and blank fields give no row; empty places give no value and take no position; repeated values count each time. An
    unbalanced quote protects nothing. Very long fields are scanned once, without recursion. Other columns, whatever their names, don't
    take part; ``pos`` and ``value`` must not be among ``keep``.
    """
    if {pos, value} & set(keep):
        raise ValueError(f"{pos} and {value} are names of the result")
    body = _trim(F.col(f"`{field}`"))
    slim = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], body.alias("whole")).where("whole <> ''")
    slim = slim.withColumn("wrap", _wrap(F.col("whole")))
    slim = slim.withColumn("body", F.expr("if(wrap = '-', whole, substring(whole, 2, length(whole) - 2))")).drop("whole", "wrap")
    ruled = slim.withColumn("skeleton", skeleton(F.col("body"))).join(F.broadcast(rule_table(df.sparkSession)), "skeleton")
    b = F.col("body")
    values = F.array(b)
    for s, pattern in DELIMITERS.items():
        values = F.when(F.col("way") == s, F.split(b, pattern)).otherwise(values)
    values = F.when(F.col("way") == "mixed", F.split(b, _DELIMITER)).otherwise(values)
    scanned = F.transform(F.regexp_extract_all(b, F.lit(_VALUE), F.lit(1)), _unprotect)
    plain = F.transform(values, _trim)
    # brackets around single values, where there are any
    bracketed = b.rlike(r"[\[{(<]") & b.rlike(r"[\]})>]")
    plain = F.when(bracketed, F.transform(plain, _unwrap)).otherwise(plain)
    values = F.when(F.col("way") == "scan", scanned).when(F.col("way") == "quoted", F.array(_unprotect(b))).otherwise(plain)
    keys = [F.col(f"k{i}").alias(k) for i, k in enumerate(keep)]
    return ruled.select(*keys, F.posexplode(F.filter(values, lambda v: v != "")).alias("at", value)).select(
        *[F.col(f"`{k}`") for k in keep], (F.col("at") + 1).cast("int").alias(pos), F.col(value)
    )
