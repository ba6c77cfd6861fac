"""Deeply nested XML records as flat, linked tables: one parse a record, then higher-order projections and one inline a table.

The parse turns a record into arrays of results, hits and children; the keys and ordinals of all ancestors are attached by nested
``transform`` calls, ``flatten`` joins the arrays, and ``inline`` emits the rows. No join and no shuffle is needed, a record is one row
until it is flat, so neither skew nor size of the table matters.
"""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptrail.session import cut_lineage

# Element, attribute and kind of a hit's children; parameters count at any depth.
CHILDREN = {
    "modification": ("mod_aminoacid_mass", "mass"),
    "score": ("search_score", "value"),
    "alternative": ("alternative_protein", "protein"),
    "parameter": ("parameter", "value"),
}
KINDS = ("hit", *CHILDREN)
_HIT = "struct<peptide:string,attributes:map<string,string>," + ",".join(f"{k}:array<string>" for k in CHILDREN) + ">"
_RECORD = f"struct<attributes:map<string,string>,results:array<array<{_HIT}>>>"
_SLIM = _RECORD.replace("attributes:map<string,string>,", "")


def parse_record(text: str | None, keep_attributes: bool = True) -> dict | None:
    """Results and hits of one spectrum_query; None for null or ill-formed text. Prefixes of element names don't matter."""
    if not text or not text.strip():
        return None
    kind_of = {tag: (kind, attribute) for kind, (tag, attribute) in CHILDREN.items()}
    record: dict = {"attributes": {}, "results": []}
    hits: list[dict] = []  # the open one, if any

    def start(name: str, attributes: dict[str, str]) -> None:
        name = name.rpartition(":")[2]
        if name == "search_hit":
            if not record["results"]:
                record["results"].append([])
            hits.append({"peptide": attributes.get("peptide", "")} | ({"attributes": attributes} if keep_attributes else {}) | {k: [] for k in CHILDREN})
            record["results"][-1].append(hits[-1])
        elif hits:
            if name in kind_of:
                kind, attribute = kind_of[name]
                hits[-1][kind].append(attributes.get(attribute, ""))
        elif name == "search_result":
            record["results"].append([])
        elif name == "spectrum_query":
            record["attributes"] = attributes

    def end(name: str) -> None:
        if hits and name.rpartition(":")[2] == "search_hit":
            hits.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(text.lstrip("﻿ \t\r\n").encode("utf-8", "replace") if "encoding=" not in text[:200] else _declared(text), True)
    except expat.ExpatError:
        return None
    return record


def _declared(text: str) -> bytes:
    """Text with an XML declaration: it is a string already, so the encoding that it names no longer holds."""
    text = text.lstrip("﻿ \t\r\n")
    return text[text.index("?>") + 2 :].encode("utf-8", "replace") if text.startswith("<?xml") and "?>" in text else text.encode("utf-8", "replace")


def parsed(df: DataFrame, xml: str, keep: list[str], attributes: bool = True) -> DataFrame:
    """``keep`` and the parsed record, with the attributes of queries and hits if wanted; null and ill-formed records have a null record."""

    @F.pandas_udf(_RECORD if attributes else _SLIM)
    def parse(texts: pd.Series) -> pd.DataFrame:
        out = [parse_record(t, attributes) for t in texts]
        results = {"results": [o and o["results"] for o in out]}
        return pd.DataFrame({"attributes": [o and o["attributes"] for o in out]} | results if attributes else results)

    return df.select(*[F.col(f"`{k}`") for k in keep], parse(F.col(f"`{xml}`")).alias("record"))


def _rows(kind: str, hit: Column, i: Column, j: Column) -> Column:
    """The rows of one kind under hit j of result i (both from 0) as an array of structs."""

    def row(n: Column, value: Column) -> Column:
        return F.struct((i + 1).alias("result_no"), (j + 1).alias("hit_no"), F.lit(kind).alias("child_kind"), n.cast("int").alias("child_no"), value.alias("child_value"))

    return F.array(row(F.lit(0), hit["peptide"])) if kind == "hit" else F.transform(hit[kind], lambda v, k: row(k + 1, v))


def _table(record: Column, kinds: tuple[str, ...]) -> Column:
    per_hit = lambda hit, i, j: F.concat(*[_rows(k, hit, i, j) for k in kinds])
    return F.flatten(F.transform(record["results"], lambda hits, i: F.flatten(F.transform(hits, lambda hit, j: per_hit(hit, i, j)))))


def flatten_children(df: DataFrame, key: str, xml: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(key, result_no, hit_no, child_kind, child_no, child_value): hits and their children in one table.

    Ordinals count from 1 in document order within their parent; empty results and hits count. An absent attribute is ''. Null, blank
    and ill-formed records give no row; repeated records give their rows each time. Extra columns don't take part.
    """
    return parsed(df, xml, [key], False).select(F.col(f"`{key}`"), F.inline(_table(F.col("record"), kinds)))


def linked_tables(df: DataFrame, key: str, xml: str) -> dict[str, DataFrame]:
    """Related tables with parent keys: queries, hits (with all attributes) and one for each kind of child.

    Every child row has (key, result_no, hit_no) of its parent hit and its own ordinal. Records are parsed once, for all tables.
    """
    base = cut_lineage(parsed(df, xml, [key]))
    k, r = F.col(f"`{key}`"), F.col("record")
    hit_rows = F.flatten(
        F.transform(r["results"], lambda hits, i: F.transform(hits, lambda h, j: F.struct((i + 1).alias("result_no"), (j + 1).alias("hit_no"), h["attributes"].alias("attributes"))))
    )
    tables = {"query": base.select(k, r["attributes"].alias("attributes"), F.coalesce(F.size(r["results"]), F.lit(0)).alias("n_results"))}
    tables["hit"] = base.select(k, F.inline(hit_rows))
    for kind in CHILDREN:
        tables[kind] = base.select(k, F.inline(_table(r, (kind,)))).drop("child_kind")
    return tables
