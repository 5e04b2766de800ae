"""Array helpers for code inside tasks: bytes, words and shingles of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in pieces of about this many bytes, to bound memory.
PIECE_BYTES = 512 << 10

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["p"]) < n:
        for k, base in (("p", _BASE), ("i", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"][:n], _powers["i"][:n]


def forget() -> None:
    """Let the tables of powers go; they grow with the longest text."""
    for k in _powers:
        _powers[k] = np.ones(1, np.uint64)


def rolling(buf: np.ndarray) -> np.ndarray:
    """Prefix sums s such that ``(s[b] - s[a]) * inverse**a`` is a hash of ``buf[a:b]``."""
    p, _ = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    sums[1:] = buf
    sums[1:] += np.uint64(1)
    sums[1:] *= p[: len(buf)]
    np.cumsum(sums, out=sums)
    return sums


def spans_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def grams_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """``spans_hash`` of all spans of ``size``, by position."""
    n = len(sums) - size
    x = sums[size:] - sums[:n]
    x *= powers(len(sums))[1][:n]
    x += np.uint64(size)
    return mix(x)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows together, and where each row begins (with the end last); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; one row at least."""
    _, at = text_bytes(batch.column(column))
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(at, at[k] + limit, "right")) - 1)
        yield batch.slice(k, end - k)
        k = end


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and per row the index of its first word (with the end last)."""
    solid = ~_WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    before, after = np.ones(len(buf), bool), np.ones(len(buf), bool)
    before[1:] = ~solid[:-1]
    after[:-1] = ~solid[1:]
    begin = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, at)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its runs of ``width`` lower-cased words.

    A row with fewer words has its whole sequence as the one shingle; a row
    without words has none.
    """
    raw, at = text_bytes(column)
    buf = _LOWER[raw]
    begin, end, first = words(buf, at)
    one = spans_hash(rolling(buf), begin, end)
    many = np.zeros(max(len(one) - width + 1, 0), np.uint64)
    for k in range(width):
        many += one[k : k + len(many)] * np.uint64((_BASE * (2 * k + 3)) & ((1 << 64) - 1) | 1)
    many = mix(many)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(many[a : b - width + 1]))
        elif b > a:
            short = one[a:b] * np.array([(_BASE * (2 * k + 3)) & ((1 << 64) - 1) | 1 for k in range(b - a)], np.uint64)
            out.append(mix(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
