"""Numbers of rows in an order, without one task that sees them all, and keyed permutations of such numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import written


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``df`` with the place of each row by ``order``, from 0. Rows are range-partitioned and numbered part by part; a number a part goes to
    the driver."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    before, sum_ = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a part
        before.append((r["part"], sum_))
        sum_ += r["n"]
    told = F.broadcast(df.sparkSession.createDataFrame(before, "part_ long, before_ long"))
    joined = placed.join(told, part == F.col("part_"), "left")
    return joined.withColumn(name, F.col("before_") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).drop("part_", "before_")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a permutation of 0 .. n - 1, told by ``key``, puts each number: four Feistel rounds on enough bits, repeated until below n."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = numbers.astype(np.uint64), np.ones(len(numbers), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> shift, x & low
        for i in range(4):
            salt = np.uint64((key * 4 + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            left, right = right, left ^ (_mixed(right + salt) & low)
        out[todo] = left << shift | right
        todo = out >= n
    return out.astype(np.int64)


def unpermuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The numbers that permuted() puts where ``numbers`` are."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = numbers.astype(np.uint64), np.ones(len(numbers), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> shift, x & low
        for i in reversed(range(4)):
            salt = np.uint64((key * 4 + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            left, right = right ^ (_mixed(left + salt) & low), left
        out[todo] = left << shift | right
        todo = out >= n
    return out.astype(np.int64)


def sent_values(rows: DataFrame, n: int, width: int, repeats: int, seed: int = 0) -> DataFrame:
    """number, key and v: for each of ``width * repeats`` permutations, as of permutations(), v is the entry ``key % width`` of the array x of
    the row where the permutation puts ``number``; ``rows`` has number (0 .. n - 1) and x."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for k in range(width * repeats):
                yield pa.RecordBatch.from_arrays([pa.array(unpermuted(at, n, seed * 1_000_003 + k)), pa.array(np.full(len(at), k, np.int32)), pa.array(x[:, k % width])], ["number", "key", "v"])

    return rows.select(F.col("number").cast("long").alias("number"), "x").mapInArrow(run, "number long, key int, v double")


def permutations(rows: DataFrame, n: int, keys: int, seed: int = 0) -> DataFrame:
    """number, key and other: ``keys`` permutations of the column number of ``rows``, which holds 0 .. n - 1."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.column(0).to_numpy()
            for k in range(keys):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(at), k, np.int32)), pa.array(permuted(at, n, seed * 1_000_003 + k))], ["number", "key", "other"])

    return rows.select(F.col("number").cast("long").alias("number")).mapInArrow(run, "number long, key int, other long")
