"""Exported PIN files that are given line by line: headers, kinds of lines and cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptrail.operators.skew import join_checked

BLANKS = " \t\r\n\f\v 　"


def _field(sep: str) -> tuple[str, str]:
    """(a field, blanks): a quoted value with blanks around it, or anything without a quote at its begin, up to the separator.

    Possessive throughout: no backtracking, and no stack that grows with the line.
    """
    blank = "[" + "".join(f"\\u{ord(c):04x}" for c in BLANKS if c != sep) + "]*+"
    return rf'(?:"(?:[^"]++|"")*+"{blank}|(?!")[^{sep}]*+)', blank


def _split(line: Column, sep: str) -> Column:
    field, blank = _field(sep)
    whole = rf"(?s)\A(?:{blank}{field}{sep})*+\z"
    values = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(rf"(?s)\G{blank}({field}){sep}"), F.lit(1))
    trim = lambda c: F.btrim(c, F.lit(BLANKS))
    bare = lambda v: F.when(v.startswith('"'), trim(F.replace(F.substring(trim(v), F.lit(2), F.length(trim(v)) - 2), F.lit('""'), F.lit('"')))).otherwise(trim(v))
    plain = F.transform(F.split(line, re.escape(sep)), trim)
    return F.when(~F.contains(line, F.lit('"')), plain).when(F.concat(line, F.lit(sep)).rlike(whole), F.transform(values, bare))


def split_line(line: Column, sep: Column) -> Column:
    """The fields of a line, separated by commas or tabs, without blanks and quotes around them; null if the quoting is broken.

    A field that begins with a double quote ends with its closing quote; two stand for one; nothing but blanks may follow it. The patterns
    run over lines with a double quote only.
    """
    return F.when(sep == ",", _split(line, ",")).otherwise(_split(line, "\t"))


def _text(line: Column) -> Column:
    """A line without byte-order mark and carriage return."""
    return F.regexp_replace(line, "^﻿|\r+$", "")


def headers(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, suffix, sep, header): one row per file that has a header, its first line that is neither comment nor blank.

    Only one candidate a file survives the partial aggregation, so a huge file costs no more than a small one.
    """
    t = _text(F.col("line_text"))
    first = (
        lines.where(F.col("line_text").isNotNull() & ~t.rlike(r"^\s*(#|$)"))
        .groupBy("file_id")
        .agg(F.min_by(F.struct("line_text"), F.struct("line_no", "line_id")).alias("h"))
    )
    named = files.select("file_id", F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)).alias("suffix")).dropDuplicates(["file_id"])
    sep = F.when(F.col("suffix") == "csv", ",").otherwise("\t")
    out = first.join(named, "file_id", "left").select("file_id", F.coalesce("suffix", F.lit("tab")).alias("suffix"), sep.alias("sep"), _text(F.col("h.line_text")).alias("t"))
    parsed = F.coalesce(split_line(F.col("t"), F.col("sep")), F.transform(F.split("t", F.col("sep")), lambda c: F.btrim(c, F.lit(BLANKS))))
    return out.withColumn("header", parsed).drop("t")


def data_lines(lines: DataFrame, schemas: DataFrame) -> DataFrame:
    """(line_id, file_id, cells, + the columns of schemas, which are made already): every data line; cells is null where the quoting is broken.

    Not data: the header and its repeats (in any case), comments, blank lines, DefaultDirection rows. Lines of a file without header have
    no schema and aren't data. Repeated lines are data each time.
    """
    t = _text(F.col("line_text"))
    slim = lines.select("line_id", "file_id", t.alias("t")).where(F.col("t").isNotNull() & ~F.col("t").rlike(r"(?i)^\s*(#|$|\"?defaultdirection\b)"))
    joined = join_checked(slim, schemas, ["file_id"], "line_id", "inner").withColumn("cells", split_line(F.col("t"), F.col("sep")))
    lower = lambda a: F.transform(a, F.lower)
    same = F.coalesce(lower(F.col("cells")) == lower(F.col("header")), F.lit(False))
    return joined.where(~same).drop("t")
