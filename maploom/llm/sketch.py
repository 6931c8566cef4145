"""Count-min sketch of 64-bit hashes: which cells of two rows are met at least twice.

Tasks send the used cells of their hashes, and those met twice, as gaps between sorted
cells; blocks of cells merge in tasks of their own.  A merged cell holds at least the
count of each hash that falls into it, so a hash with a cell below two occurs once.
What tasks then need is one bit a cell.  Its size is fixed by ``MAX_BITS`` (64 MB for
both rows) however large the input; a fuller sketch passes more hashes on and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: log2 of the cells of one row: bounds what is broadcast to 2 * 2**28 bits.
MAX_BITS = 28
MIN_BITS = 16
BLOCK_BITS = 20
SCHEMA = pa.schema([("sketch_row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
COLUMNS = "sketch_row int, block int, once binary, twice binary"


def bits_for(n: int) -> int:
    """log2 of the cells for ``n`` hashes: two to four cells a hash, up to the bound."""
    return int(np.clip(int(2 * n).bit_length(), MIN_BITS, MAX_BITS))


def _gaps(cells: np.ndarray) -> bytes:
    """Sorted distinct cells as bytes: the gaps, with 255 for each whole 255."""
    gap = np.diff(cells, prepend=-1) - 1
    whole, rest = np.divmod(gap, 255)
    out = np.full(int(whole.sum()) + len(gap), 255, dtype=np.uint8)
    out[np.cumsum(whole + 1) - 1] = rest
    return out.tobytes()


def _ungap(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8)
    at = np.cumsum(raw, dtype=np.int64)
    ends = np.flatnonzero(raw != 255)
    return at[ends] + np.arange(len(ends))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h >> np.uint64(36 if row else 0)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def emit(h: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """What a task sends of its hashes."""
    width = min(bits, BLOCK_BITS)
    for row in (0, 1):
        cells = np.sort(_cells(h, row, bits))
        fresh = np.ones(len(cells), dtype=bool)
        fresh[1:] = cells[1:] != cells[:-1]
        again = np.unique(cells[~fresh])
        cells = cells[fresh]
        edge = np.arange(1 << (bits - width)) << width
        parts = [np.append(np.searchsorted(x, edge), len(x)) for x in (cells, again)]
        out = [(row, b, *(_gaps(x[p[b] : p[b + 1]] - (b << width)) for x, p in zip((cells, again), parts))) for b in range(len(edge))]
        yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, x)) for x in out], schema=SCHEMA)


def _merge(width: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << width, dtype=np.uint8)
        for batch in batches:
            for once, twice in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
                at = _ungap(once)
                seen[at] = np.minimum(seen[at] + 1, 2)
                seen[_ungap(twice)] = 2
        yield pa.RecordBatch.from_arrays([pa.array([int(key[0].as_py())], pa.int32()), pa.array([int(key[1].as_py())], pa.int32()), pa.array([np.packbits(seen >= 2, bitorder="little").tobytes()])], names=["sketch_row", "block", "bits"])

    return run


def repeated_cells(parts: DataFrame, bits: int) -> np.ndarray:
    """Bit table of two rows, from what tasks sent: cells whose merged count is two or more."""
    width = min(bits, BLOCK_BITS)
    merged = parts.groupBy("sketch_row", "block").applyInArrow(_merge(width), "sketch_row int, block int, bits binary")
    table = np.zeros((2, 1 << (bits - 3)), dtype=np.uint8)
    for r in merged.toLocalIterator():  # 2 ** (bits - 2) bytes in all
        at = r["block"] << (width - 3)
        table[r["sketch_row"], at : at + len(r["bits"])] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table


def suspects(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes may occur more than once."""
    keep = np.ones(len(h), dtype=bool)
    for row in (0, 1):
        cell = _cells(h, row, bits)
        keep &= (table[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return keep
