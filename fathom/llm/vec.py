"""Vectorised text work inside Arrow tasks: byte buffers, words and word hashes without an object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; the arrays made from them take some tens of times as much.
SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the inclusive ranges."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and whatever isn't ASCII.
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of words [^\x20\x09-\x0D]+ .
GRAPH = ~byte_table((0x20, 0x20), (0x09, 0x0D))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def slices(column: pa.Array, most: int = SLICE_BYTES, most_rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows in runs of about `most` bytes, at most `most_rows`: (first row, row after the last, bytes, offsets from 0)."""
    data, ends = column_bytes(column)
    row, rows = 0, len(ends) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        last = min(last, row + most_rows)
        yield row, last, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


def runs(member: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of True; a run never crosses a row's end."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = member.copy(), member.copy()
    opens[1:] &= ~member[:-1]
    closes[:-1] &= ~member[1:]
    begin = ends[:-1][ends[:-1] < ends[1:]]
    opens[begin] = member[begin]
    closes[begin[1:] - 1] = member[begin[1:] - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(ends, starts, side="right") - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, rising byte runs; equal runs have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(value * _powers(base, int(lengths.max()))[place], first))
