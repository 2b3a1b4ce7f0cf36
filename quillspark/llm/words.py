"""Words, shingles and their 64-bit hashes over whole Arrow string columns, with numpy.

A column's UTF-8 bytes are cut into blocks of about ``BLOCK`` bytes (a longer text is a block of its own) so that
temporary arrays stay small whatever the length of a batch. A word is a run of bytes other than 0x20 and 0x09-0x0D.
A null text counts as an empty one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


def _powers(n: int, base: int, known: dict = {}) -> np.ndarray:  # noqa: B006  kept from call to call
    if base not in known or len(known[base]) < n:
        size = max(n, BLOCK + 1)
        known[base] = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, base, _U)]), dtype=_U)
    return known[base][:n]


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in these bytes and their end) for each block of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word and the number of words). ``fold`` lower-cases A-Z."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.zeros(n + 1, _U)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * _powers(n, _BASE), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _powers(n + 1, _INVERSE)[starts]
    return mix(raw + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words inside a row, in order; index of each row's first and the number).

    A row with fewer words, but at least one, has its whole sequence as its only shingle."""
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    rows = np.repeat(np.arange(len(count)), made)
    where = first[rows] + (np.arange(at[-1]) - at[rows])
    padded = np.concatenate([words, np.zeros(k, _U)])
    short = np.minimum(count, k)[rows]
    out = short.astype(_U) * _U(0xA24BAED4963EE407)
    for j in range(k):
        part = padded[where + j] * _U((0x9FB21C651E98DF25 + 2 * j * 0x632BE59BD9B4E019) & (2**64 - 1) | 1)
        if j and len(short) and short.min() <= j:
            part = np.where(short > j, part, _U(0))
        out = mix(out + part) if j % 2 else out + part
    return mix(out), at
