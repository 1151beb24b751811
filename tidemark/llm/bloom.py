"""Bloom filters over 16-byte digests: a pair for what was seen once and twice, built by tasks and merged by bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits set by a key; bits of a filter for each expected key, at least.
HASHES, BITS_PER_KEY = 4, 12
#: A filter's bits are a power of two between these, so that 128 MB are the most that a worker holds of each filter.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30
#: Bytes of a filter that are merged as one row.
PIECE = 1 << 16


def bits_for(keys: int, most: int = MOST_BITS) -> int:
    """The size of a filter for so many keys; beyond `most` bits it lets more keys through, but never loses one."""
    return min(most, max(LEAST_BITS, 1 << (max(1, keys) * BITS_PER_KEY - 1).bit_length()))


def digests_of(column: pa.Array) -> np.ndarray:
    """A binary column of 16-byte values without nulls, as pairs of unsigned numbers."""
    column = column.cast(pa.binary(16))
    return np.frombuffer(column.buffers()[1], "<u8")[2 * column.offset : 2 * (column.offset + len(column))].reshape(-1, 2) if len(column) else np.empty((0, 2), "<u8")


def places(digests: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES bits of each digest: a row a digest."""
    steps = np.arange(HASHES, dtype="<u8")
    return (digests[:, :1] + steps * (digests[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def _set(table: np.ndarray, at: np.ndarray) -> None:
    """Set the bits `at` (ascending, distinct) of a packed table."""
    if len(at):
        byte, bit = (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8)
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        table[byte[first]] |= np.bitwise_or.reduceat(bit, first)


def has(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows of places are set altogether."""
    return ((table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class Pair:
    """Bits set by a key at least (`once`), and by two keys or one key twice at least (`twice`)."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, digests: np.ndarray) -> None:
        at = np.sort(places(digests, self.bits), axis=None)
        again = at[1:] == at[:-1]
        at_once, at_twice = at[np.r_[True, ~again]] if len(at) else at, at[1:][again]
        seen = at_once[has(self.once, at_once[:, None])]
        _set(self.twice, np.union1d(seen, at_twice))
        _set(self.once, at_once)


def seen_twice(keys: DataFrame, column: str, bits: int, tasks: int) -> np.ndarray:
    """The bits that at least two of `keys` (binary(16), each row counts) have set: a superset of those of repeated keys.

    `tasks` tasks fill a pair each; two pairs merge as once = a or b, twice = either's twice or what both have once. What
    moves is two filters a task, in pieces, whatever the number of keys; the driver takes the merged one.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            pair = pair or Pair(bits)
            pair.add(digests_of(batch.column(0)))
        for at in range(0, bits // 8 if pair else 0, PIECE):
            once, twice = (x[at : at + PIECE] for x in (pair.once, pair.twice))
            if once.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([at // PIECE], pa.int64()), "once": pa.array([once.tobytes()], pa.binary()), "twice": pa.array([twice.tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for piece, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(x, np.uint8) for x in (once, twice))
                if piece in pieces:
                    a0, b0 = pieces[piece]
                    a, b = a | a0, b | b0 | (a & a0)
                pieces[piece] = a, b
        for piece, (_, b) in pieces.items():
            if b.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int64()), "twice": pa.array([b.tobytes()], pa.binary())})

    filled = keys.select(column).coalesce(tasks).mapInArrow(fill, "piece long, once binary, twice binary")
    merged = filled.repartition(min(tasks, -(-bits // 8 // PIECE)), "piece").mapInArrow(merge, "piece long, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row.piece * PIECE : row.piece * PIECE + len(row.twice)] = np.frombuffer(row.twice, np.uint8)
    return out


def filter_of(keys: DataFrame, column: str, bits: int, tasks: int) -> np.ndarray:
    """A plain filter of `keys` (binary(16)): bits that at least one has set."""
    return seen_twice(keys.unionAll(keys), column, bits, tasks)


def might_hold(spark, table: np.ndarray, column: Column) -> Column:
    """Whether the filter lets a binary(16) value through; null values don't pass. The table is broadcast: its size is bounded."""
    shared, bits = spark.sparkContext.broadcast(table), len(table) * 8

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        digests = np.frombuffer(b"".join(values[known]), "<u8").reshape(-1, 2)
        out = np.zeros(len(values), bool)
        out[known] = has(shared.value, places(digests, bits))
        return pd.Series(out)

    return test(column)
