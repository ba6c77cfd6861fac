"""Rows packed into binary blocks, and passes over them that add up arrays.

A learner reads the same numbers dozens of times. They are packed once, a few thousand rows a block, and kept; a pass is one map over the
blocks, and its result an array whose size doesn't depend on the rows. Arrays of many tasks are added up in a tree.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Arrays that one task of the tree adds up, or the driver.
FAN = 64
_SCHEMA = "n int, y binary, fold binary, part binary, x binary"


@dataclass(frozen=True)
class Block:
    """x: rows by columns, NaN where a value is missing; y: True for targets; fold and part: small integers."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    part: np.ndarray


@dataclass(frozen=True)
class Blocks:
    df: DataFrame
    columns: int
    tasks: int

    def close(self) -> None:
        self.df.unpersist()


def pack(df: DataFrame, columns: list[Column], target: Column, fold: Column | None = None, part: Column | None = None) -> Blocks:
    """df's columns in kept blocks. Rows without a target don't take part; a null or NaN value is NaN."""
    zero, d = F.lit(0), len(columns)
    slim = df.select(target.alias("y"), (zero if fold is None else fold).cast("int").alias("f"), (zero if part is None else part).cast("int").alias("p"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).where("y is not null")

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y, fold_, part_ = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                x = np.empty((b.num_rows, d))
                for i in range(d):
                    x[:, i] = b.column(3 + i).to_numpy(zero_copy_only=False)
                row = [[b.num_rows], [y.astype(bool).tobytes()], [fold_.astype(np.int32).tobytes()], [part_.astype(np.int32).tobytes()], [x.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(v, pa.binary()) for v in row[1:])], names=["n", "y", "fold", "part", "x"])

    cores, tasks = df.sparkSession.sparkContext.defaultParallelism, slim.rdd.getNumPartitions()
    if tasks < cores:  # few input splits: spread the work over the cores
        slim, tasks = slim.repartition(cores), cores
    return Blocks(slim.mapInArrow(make, _SCHEMA).persist(StorageLevel.MEMORY_AND_DISK), d, tasks)


def _block(b: pa.RecordBatch, i: int, d: int) -> Block:
    y, fold, part, x = (b.column(k)[i].as_buffer() for k in range(1, 5))
    return Block(np.frombuffer(x).reshape(-1, d), np.frombuffer(y, bool), np.frombuffer(fold, np.int32), np.frombuffer(part, np.int32))


def add_up(blocks: Blocks, per_block: Callable[[Block], np.ndarray], size: int, kind: type = np.float64) -> np.ndarray:
    """The sum of per_block's arrays (of ``size`` numbers) over all blocks: in the tasks, then by FAN at a time, last of all here."""
    d = blocks.columns

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for b in batches:
            for i in range(b.num_rows):
                total += per_block(_block(b, i, d))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["v"])

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(zlib.decompress(v.as_buffer()), kind)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["v"])

    parts, n = blocks.df.mapInArrow(partial, "v binary"), blocks.tasks
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(combine, "v binary")
    total = np.zeros(size, kind)
    for r in parts.collect():
        total += np.frombuffer(zlib.decompress(bytes(r[0])), kind)
    return total
