"""Vectorised helpers for Arrow batches of text: byte buffers, word spans, word and gram hashes.

They run inside ``mapInArrow`` tasks and see one batch at a time; Spark does the partitioning.
All hashes are functions of the bytes alone, so every executor computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of about this many bytes are handled together.
BLOCK = 1 << 20
#: Documents in a block at most; a document's number in its block fits in 12 bits.
BLOCK_DOCS = 4096
_U = np.uint64
_BASE, _GOLD = _U(0x9E3779B97F4A7C15 | 1), _U(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def byte_table(low_ranges: str) -> np.ndarray:
    """True for bytes that belong to a word; ``low_ranges`` is a list of separators as hex ranges."""
    table = np.ones(256, bool)
    for part in low_ranges.split():
        a, _, b = part.partition("-")
        table[int(a, 16) : int(b or a, 16) + 1] = False
    return table


#: Words are runs of bytes that aren't ASCII white space.
SPACED = byte_table("20 09-0D")
#: Words are runs of ASCII letters, digits and all beyond ASCII (A-Z as a-z).
ALNUM = byte_table("00-2F 3A-40 5B-60 7B-7F")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and those of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        base, inverse = np.full(size, _BASE), np.full(size, _U(pow(int(_BASE), -1, 1 << 64)))
        base[0] = inverse[0] = 1
        _powers[:] = [np.cumprod(base), np.cumprod(inverse)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + BLOCK_DOCS, n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of its first word (n + 1 values)."""
    inside = table[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        before[cuts], after[cuts - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``fold`` takes A-Z as a-z."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        base = starts[i]
        part = data[base : ends[j - 1]]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(((LOWER[part] if fold else part).astype(_U) + _U(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _GOLD
        i = j
    return mix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; runs that cross rows are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += words[j : j + n]
    return mix(out + _U(k * int(_GOLD) & (1 << 64) - 1))


def gram_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows whose words begin at ``first``: the place of each whole k-gram, and its row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return place, row


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    out, span = x, 1
    while span < w:
        step = min(span, w - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def minimisers(x: np.ndarray, w: int, rows: np.ndarray) -> np.ndarray:
    """Places of the leftmost least value (by its upper 40 bits) in every window of w values that lies in one row."""
    if len(x) < w:
        return np.zeros(0, np.int64)
    low = _U((1 << 24) - 1)
    place = np.arange(len(x), dtype=_U)
    least = sliding_min((x & ~low) | (place & low), w)
    n = len(least)
    whole = rows[:n] == rows[w - 1 :]
    at = place[:n][whole]
    chosen = (at + ((least[whole] - at) & low)).astype(np.int64)
    return chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]


def frame(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
