"""Count-min sketches of 64-bit digests, gathered over all tasks; their size is bounded, whatever the table's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import mixed

#: Hash rows of a sketch, most cells of a row (64 MB in all), and the cells that travel together.
ROWS, MOST_CELLS, BLOCK = 4, 1 << 24, 1 << 16


def cells_for(n: int, most: int = MOST_CELLS) -> int:
    """Cells of a row for n digests: about four for each, a power of two. More digests than that fill the sketch, which then rules out less but stays right."""
    return min(most, 1 << max(16, (4 * max(n, 1) - 1).bit_length()))


def places(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mixed(h + np.uint64((2 * row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(cells - 1)).astype(np.int64)


def gathered(rows: DataFrame, digests: Callable[[pa.RecordBatch], np.ndarray], cells: int, most: int) -> np.ndarray:
    """A sketch of ROWS x cells counts that stop at `most`, of all digests in rows.

    Each task sketches its own rows; blocks of its cells are added up by block, so that only the finished sketch reaches the driver.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, any_ = np.zeros(ROWS * cells, np.uint8), False
        for batch in batches:
            h = digests(batch)
            for row in range(ROWS if len(h) else 0):
                at, n = np.unique(places(h, row, cells), return_counts=True)
                at += row * cells
                table[at] = np.minimum(most, table[at] + np.minimum(n, most))
                any_ = True
        for a in range(0, len(table) if any_ else 0, BLOCK):
            if (part := table[a : a + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], ["block", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(pa.decompress(part.as_buffer(), BLOCK, "zstd"), np.uint8)
                held[block] = np.minimum(most, held[block] + new) if block in held else new
        for block, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], ["block", "part"])

    schema = "block int, part binary"
    parts = rows.mapInArrow(own, schema).repartition("block").mapInArrow(added, schema)
    out = np.zeros(ROWS * cells, np.uint8)
    for r in parts.toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(pa.decompress(bytes(r["part"]), BLOCK, "zstd"), np.uint8)
    return out.reshape(ROWS, cells)


def estimate(sketch: np.ndarray, h: np.ndarray) -> np.ndarray:
    """At least the count of each digest, where that is under the sketch's bound."""
    cells = sketch.shape[1]
    out = sketch[0][places(h, 0, cells)]
    for row in range(1, ROWS):
        out = np.minimum(out, sketch[row][places(h, row, cells)])
    return out
