"""Sentence units of documents in all languages and scripts.

A document's text is turned into events (boundary_events) and these run through finite transducers (boundary_machine). A document longer
than CHUNK characters is cut into chunks, which are read wherever they land. What a chunk does to the machines is a table of a few hundred
bytes; a document's tables, and only these, meet in one task, where a prefix scan composes them and tells each chunk the state it begins in.
Each chunk then gives its own units. Shorter documents never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.boundary_events import CONTEXT, events, gaps
from peptrail.llm.boundary_machine import COUNT, PAIRS, STATES, join_stretches, main_function, mark_openers, pair_functions, scan_main, scan_pairs, symbols, units_of
from peptrail.session import cut_lineage, reduce_partitions

#: Characters of a chunk, about: it ends at the next place between two letters, so that no run of blanks, digits or marks is ever cut. A text
#: has at most 2^31 bytes, so a document has at most 65,536 chunks.
CHUNK = 32_768
_LETTERS = re.compile(r"(?<=[^\W\d_])(?=[^\W\d_])")


def cuts(text: str, chunk: int) -> list[int]:
    """Where the chunks of a text begin, and its length."""
    out, a = [0], chunk
    while a < len(text) and (found := _LETTERS.search(text, a)):
        at = found.start()
        if text[at - 1].isalpha() and text[at].isalpha():
            out.append(at)
            a = at + chunk
        else:
            a = at + 1
    return [*out, len(text)]


def part_of(text: str, a: int, b: int) -> tuple[str, int]:
    """text[a:b] with its neighbours, and where that begins; a cut within the text must not look like its begin."""
    low = max(0, a - CONTEXT)
    return ("x" + text[low : b + CONTEXT], low - 1) if low else (text[: b + CONTEXT], 0)


def stretch_of(part: str, origin: int, a: int, b: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Events and extents of the chunk from a to b, read in its part, which begins at origin."""
    found = events(part, a - origin, b - origin)
    extents = gaps(part, a - origin, b - origin, found)
    if origin:
        found = [(at + origin, k, x) for at, k, x in found]
        extents = [(x + origin, y + origin) if x >= 0 else (x, y) for x, y in extents]
    return found, extents


def text_units(text: str, chunk: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of one text, read at once or in chunks."""
    at = [0, len(text)] if chunk is None else cuts(text, chunk)
    return join_stretches([stretch_of(*part_of(text, a, b), a, b) for a, b in zip(at, at[1:])])


def _numbers(rows: list, width: int) -> list[tuple]:
    return list(map(tuple, np.asarray(rows).reshape(-1, width).tolist()))


def _matrix(cells: pd.Series, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(-1, *shape)


def _symbols_of(b: pd.DataFrame) -> Iterator[tuple[list, tuple[int, int]]]:
    for f, e, c, o in zip(b["found"], b["extents"], b["come"], b["opened"]):
        found = _numbers(f, 3)
        yield symbols(found, _numbers(e, 2), mark_openers(found, list(c)), list(o))


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, start_char, end_char): one row per sentence unit, positions in Unicode characters from 0, the end exclusive.

    Every character that isn't white space lies in exactly one unit of its row. Null, empty and blank texts give no row; repeated rows and
    equal texts give their units each time; extra columns don't take part. Texts of any length are read whole; where they are cut into
    chunks doesn't change the units.
    """
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, start_char long, end_char long"
    slim = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("t")).where(F.col("t").rlike(r"\S"))

    def rows(keys: pa.Array, units: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(units)), np.array([len(u) for u in units], np.int64))
        flat = np.fromiter(chain.from_iterable(chain.from_iterable(units)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=[key, "start_char", "end_char"])

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(b.column(0), [text_units(t) for t in b.column(1).to_pylist()])

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, row, t in zip(b[key], b["row"], b["t"]):
                at = cuts(t, chunk)
                parts = [(a, e, *part_of(t, a, e)) for a, e in zip(at, at[1:])]
                yield pd.DataFrame({key: [k] * len(parts), "row": row, "begin": at[:-1], "stop": at[1:], "part": [p[2] for p in parts], "origin": [p[3] for p in parts]})

    def classify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for a, e, part, origin in zip(b["begin"], b["stop"], b["part"], b["origin"]):
                found, extents = stretch_of(part, origin, a, e)
                back, ahead = pair_functions(found)
                made.append((np.array(found, np.int64).ravel(), np.array(extents, np.int64).ravel(), back.tobytes(), ahead.tobytes()))
            yield b[[key, "row", "begin"]].assign(**{n: [m[i] for m in made] for i, n in enumerate(("found", "extents", "back", "ahead"))})

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("begin")
        come, opened = scan_pairs(_matrix(g["back"], np.int8, PAIRS + 1, COUNT), _matrix(g["ahead"], np.int8, COUNT, PAIRS + 1, COUNT))
        last = [False] * (len(g) - 1) + [True]
        return pd.DataFrame({"row": g["row"], "begin": g["begin"], "come": list(come), "opened": list(opened), "last": last})

    def effects(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [main_function(marks, rest) for marks, rest in _symbols_of(b)]
            yield pd.DataFrame({"row": b["row"], "begin": b["begin"], "f": [m[0].astype(np.int8).tobytes() for m in made], "ends": [m[1].tobytes() for m in made], "opens": [m[2].astype(np.int64).tobytes() for m in made], "until": [m[3] for m in made]})

    def states(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("begin")
        found, at, to = scan_main(_matrix(g["f"], np.int8, STATES).astype(np.int64), _matrix(g["ends"], bool, STATES), _matrix(g["opens"], np.int64, STATES), g["until"].to_numpy())
        return pd.DataFrame({"row": g["row"], "begin": g["begin"], "state": found, "open_at": at, "open_to": to})

    def give(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = [units_of(marks, rest, *more) for (marks, rest), more in zip(_symbols_of(b), zip(b["state"], b["open_at"], b["open_to"], b["last"]))]
            for k, units in zip(b[key], of):
                yield pd.DataFrame({key: [k] * len(units), "start_char": [x for x, _ in units], "end_char": [y for _, y in units]})

    length = F.length("t")
    short = slim.where(length <= chunk).mapInArrow(whole, out)
    # a row id of its own keeps repeated rows apart
    chunks = slim.where(length > chunk).withColumn("row", F.monotonically_increasing_id()).mapInPandas(cut, f"{key} {kind}, row long, begin long, stop long, part string, origin long")
    spread = chunks.repartition(reduce_partitions(df), "row", "begin")
    read = cut_lineage(spread.mapInPandas(classify, f"{key} {kind}, row long, begin long, found array<long>, extents array<long>, back binary, ahead binary"))
    paired = read.select("row", "begin", "back", "ahead").groupBy("row").applyInPandas(pairs, "row long, begin long, come array<int>, opened array<int>, last boolean")
    ready = read.drop("back", "ahead").join(cut_lineage(paired), ["row", "begin"])
    entered = ready.mapInPandas(effects, "row long, begin long, f binary, ends binary, opens binary, until long").groupBy("row").applyInPandas(states, "row long, begin long, state int, open_at long, open_to long")
    return short.unionByName(ready.join(entered, ["row", "begin"]).mapInPandas(give, out))
