"""Per-key results where a few keys hold most rows: dense accumulator arrays over equal input splits.

Each input split dictionary-encodes its keys and scatter-reduces its rows into dense NumPy arrays, whatever the keys' skew: a key that
holds a third of all rows costs a split one array slot. The arrays are cut into blocks by a hash of the key, and a distributed
reduction merges the blocks, again into dense arrays. Nothing is ever grouped by key as rows, so no task depends on a hot key; what is
shuffled is at most one entry per key and split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.session import reduce_partitions

#: Entries of a split's dictionary after which its arrays are handed on and begun anew: a bound of memory, not of the result.
FLUSH_ENTRIES = 250_000
_BLOCK = "block int, keys array<string>, best array<double>, row array<long>, n array<long>"


class Accumulator:
    """Dictionary-encoded keys with dense arrays: best score, smallest row id among the best, number of rows."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.best, self.row, self.n = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, score: np.ndarray, row: np.ndarray, n: np.ndarray) -> None:
        """Scatter-reduce entries into the arrays; new keys get the next codes."""
        local, uniques = pd.factorize(keys)
        size = len(uniques)
        best = np.full(size, -np.inf)
        np.maximum.at(best, local, score)
        top = score == best[local]
        first = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(first, local[top], row[top])
        count = np.bincount(local, weights=n, minlength=size).astype(np.int64)
        code = self.code
        at = np.fromiter((code.setdefault(k, len(code)) for k in uniques), np.int64, size)
        if (grown := len(code)) > len(self.best):
            more = max(grown, 2 * len(self.best)) - len(self.best)
            self.best = np.concatenate([self.best, np.full(more, -np.inf)])
            self.row = np.concatenate([self.row, np.full(more, np.iinfo(np.int64).max)])
            self.n = np.concatenate([self.n, np.zeros(more, np.int64)])
        wins = (best > self.best[at]) | ((best == self.best[at]) & (first < self.row[at]))
        self.best[at[wins]], self.row[at[wins]] = best[wins], first[wins]
        self.n[at] += count

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        k = len(self.code)
        return np.array(list(self.code), dtype=object), self.best[:k], self.row[:k], self.n[:k]


def _emit_blocks(acc: Accumulator, blocks: int) -> Iterator[pd.DataFrame]:
    keys, best, row, n = acc.arrays()
    block = (pd.util.hash_array(keys, categorize=False) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
    for idx in np.split(order, cuts[1:]):
        if len(idx):
            yield pd.DataFrame({"block": [block[idx[0]]], "keys": [keys[idx]], "best": [best[idx]], "row": [row[idx]], "n": [n[idx]]})


def accumulate(df: DataFrame, key: str, score: str, row_id: str) -> DataFrame:
    """(key, best_score, row_id, n): for every key the highest score, the smallest row id that has it, and the number of rows.

    Rows with a null key, a null score or a NaN score don't take part. Keys are compared exactly as written (an empty or blank string
    is a key). Among equal scores the smallest row id wins, -0.0 equals 0.0. Repeated rows count each time; an empty table gives none.
    """
    slim = df.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{score}`").cast("double").alias("s"), F.col(f"`{row_id}`").cast("long").alias("r"))
    slim = slim.where("k is not null and s is not null and not isnan(s) and r is not null")
    parts = reduce_partitions(df)
    blocks = parts * 8

    def scatter(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = Accumulator()
        for b in batches:
            acc.add(b["k"].to_numpy(), b["s"].to_numpy(), b["r"].to_numpy(), np.ones(len(b)))
            if len(acc.code) > FLUSH_ENTRIES:
                yield from _emit_blocks(acc, blocks)
                acc = Accumulator()
        yield from _emit_blocks(acc, blocks)

    def merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = Accumulator()
        for b in batches:
            if len(b):
                acc.add(*(np.concatenate([np.asarray(x) for x in b[c]]) for c in ("keys", "best", "row", "n")))
        keys, best, row, n = acc.arrays()
        for i in range(0, len(keys), 50_000):
            j = slice(i, i + 50_000)
            yield pd.DataFrame({"k": keys[j], "s": best[j], "r": row[j], "n": n[j]})

    merged = slim.mapInPandas(scatter, _BLOCK).repartition(parts, "block").mapInPandas(merge, "k string, s double, r long, n long")
    return merged.select(F.col("k").alias(key), F.col("s").alias("best_score"), F.col("r").alias(row_id), F.col("n").alias("n"))
