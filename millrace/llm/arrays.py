"""Vectorised text primitives: words and rolling hashes over the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at a time, and of the longest run that is hashed by a prefix sum.
WINDOW, SHORT = 1 << 18, 64


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, after which the worker gives back the memory that it no longer needs.

    Workers are used again by later stages, and allocators keep what a stage has freed.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return tidied


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its len+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if where is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that separators (a table of 256 flags) doesn't mark: starts, ends, and per row the index of its first run (len rows + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a row ends a word
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each run, starts ascending.

    Runs of SHORT bytes at most share one prefix sum of byte * BASE**position a window
    of the data, so memory doesn't grow with a text's length; longer runs, for which
    such sums modulo 2**64 can be made to collide, have a cryptographic hash.
    """
    out = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    short = np.flatnonzero(sizes <= SHORT)
    size = min(WINDOW, len(data)) + SHORT
    shifts, back = powers(BASE, size), powers(BASE_INVERSE, size + 1)
    begin = starts[short]
    edges = np.searchsorted(begin, np.arange(0, len(data) + WINDOW, WINDOW))
    for w, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if a == b:
            continue
        own = short[a:b]
        part = data[w * WINDOW : (w + 1) * WINDOW + SHORT]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * shifts[: len(part)], out=total[1:])
        at = starts[own] - w * WINDOW
        out[own] = mixed((total[at + sizes[own]] - total[at]) * back[at] + sizes[own].astype(np.uint64) * STEP)
    held = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(held[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def sequence_digests(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> list[bytes]:
    """SHA-256 of each row's runs, joined by single spaces."""
    outside = separators[data]
    starts_row = np.zeros(len(data) + 1, bool)
    starts_row[offsets] = True
    # a separator stays where a run ends before it in its row; one that ends the row goes below
    after = np.zeros(len(data), bool)
    after[1:] = ~outside[:-1] & ~starts_row[1 : len(data)]
    kept = ~outside | after
    joined = np.where(outside, np.uint8(32), data)[kept]
    held = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[offsets]
    view, out = memoryview(np.ascontiguousarray(joined)), []
    for a, b in zip(held[:-1].tolist(), held[1:].tolist()):
        out.append(hashlib.sha256(view[a : b - 1 if b > a and view[b - 1] == 32 else b]).digest())
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes; len(words) - k + 1 of them, rows not respected."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= STEP
        out += words[j : j + n]
    return mixed(out)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Flags of the byte values within the inclusive ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Space and the control characters from tab to carriage return.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
