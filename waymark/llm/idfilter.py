"""A fixed-size filter of ids: tells which rows need not travel to a join.

The filter is a bit array of ``FILTER_BITS`` bits (1 MB whatever the input), set
at the hash of each id.  It never loses a row; the fuller it is, the more rows
pass that the join then drops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import mix
from .worker import tidy

FILTER_BITS = 1 << 23
_SLICES = 16
NO_ID = np.iinfo(np.int64).max


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as numbers; null is the largest."""
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def place(ids: np.ndarray, places: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(places)).astype(np.int64)


def _slices(read: Callable[[pa.RecordBatch], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[place(read(batch), FILTER_BITS)] = True
        parts = np.packbits(bits).reshape(_SLICES, -1)
        used = [k for k in range(_SLICES) if parts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], ["slice", "bits"])

    return run


@tidy
def _union(group: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("bits").to_pylist()])
    return pa.table({"slice": group.column("slice")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})


def id_filter(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The filter of all ids that ``read`` finds in the rows."""
    parts = rows.mapInArrow(_slices(read), "slice int, bits binary").groupBy("slice").applyInArrow(_union, "slice int, bits binary")
    whole = np.zeros((_SLICES, FILTER_BITS // 8 // _SLICES), np.uint8)
    for r in parts.collect():  # 16 rows of 64 KB
        whole[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return whole.reshape(-1)


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = place(ids, FILTER_BITS)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def having(bits: np.ndarray, column: str = "id", keep: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel for ``mapInArrow``: the rows whose id may be in the filter, or with ``keep=False`` the others."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, ids_of(batch.column(column))) == keep))

    return run
