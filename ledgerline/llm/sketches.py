"""Count-min sketches over 128-bit digests, counted up to two and merged block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ROWS = 4
BLOCK = 1 << 16


def cells(k1: np.ndarray, k2: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each digest in each row of a sketch, rows one behind the other."""
    a, b = k1.astype(np.uint64), k2.astype(np.uint64)
    lanes = (a, a >> np.uint64(32), b, b >> np.uint64(32))
    return [(lane & np.uint64(width - 1)).astype(np.int64) + i * width for i, lane in enumerate(lanes)]


def marked(bits: np.ndarray, k1: np.ndarray, k2: np.ndarray, width: int) -> np.ndarray:
    """Whether all cells of each digest have their bit set."""
    left = np.ones(len(k1), bool)
    for cell in cells(k1, k2, width):
        left &= (bits[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
    return left


def width_for(n: int, most: int) -> int:
    """Cells of a row: a power of two, eight for each of ``n`` digests, ``most`` at most."""
    return min(most, max(1 << 12, 1 << (8 * n - 1).bit_length()))


def screen(digests: DataFrame, width: int, least: int = 2) -> bytes:
    """A bit for each cell that ``least`` (1 or 2) digests (k1, k2) or more fell into.

    Tasks send one row for each block of cells, so what meets in a task is bounded by the sketch.
    """

    def count(batches):
        seen = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            for found in cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), width):
                place, n = np.unique(found, return_counts=True)
                seen[place] = np.minimum(seen[place] + np.minimum(n, 2), 2)
        size = min(BLOCK, width)
        for start in range(0, len(seen), size):
            block = seen[start : start + size]
            if block.any():
                made = [pa.array([start]), *(pa.array([np.packbits(block >= k).tobytes()]) for k in (1, 2))]
                yield pa.RecordBatch.from_arrays(made, names=["start", "once", "twice"])

    def merge(batches):
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for start, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
                old = state.get(start)
                state[start] = (old[0] | new[0], old[1] | new[1] | (old[0] & new[0])) if old else new
        for start, kept in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([kept[least - 1].tobytes()])], names=["start", "bits"])

    counted = digests.select("k1", "k2").mapInArrow(count, "start long, once binary, twice binary")
    merged = counted.repartition("start").mapInArrow(merge, "start long, bits binary").toArrow()
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for start, part in zip(merged["start"].to_pylist(), merged["bits"].to_pylist()):
        bits[start // 8 : start // 8 + len(part)] = np.frombuffer(part, np.uint8)
    return bits.tobytes()


def member_test(keys: DataFrame, columns: list[str], n: int, most: int) -> Callable[[], Column]:
    """A condition that holds for every row whose ``columns`` are those of a row of ``keys``, and for few others."""
    digest = [F.xxhash64(F.lit(i), *columns) for i in (1, 2)]
    width = width_for(n, most)
    sent = keys.sparkSession.sparkContext.broadcast(screen(keys.select(digest[0].alias("k1"), digest[1].alias("k2")), width, 1))

    @F.pandas_udf("boolean")
    def held(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(marked(np.frombuffer(sent.value, np.uint8), k1.to_numpy(), k2.to_numpy(), width))

    return lambda: held(*digest)
