"""Whole texts as UTF-8 byte arrays: words, word hashes and shingles of many documents at once.

Everything here is a small helper for code that runs inside Spark tasks. A text
is never cut: a chunk holds whole documents and a document longer than the chunk
size is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the public SplitMix64 generator."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(_STEP))
LOWER_CODES = BYTE_CODES[LOWER]
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, U)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in these bytes), whole rows only."""
    data, offsets = text_column(column)
    n, low = len(offsets) - 1, 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a document's edge: starts, ends and, for
    each document, the index of its first run (n + 1 of them)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    edges = edges[1:] - 1
    stops[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """64-bit hashes of byte ranges, the same wherever a range stands."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(_STEP))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lower-cased words and each document's first word's index."""
    starts, ends, first = spans(~SPACE[data], offsets)
    return span_hashes(data, starts, ends, LOWER_CODES), first


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each item, from each document's first item's index."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours in a row."""
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(hashes) - k + 1), U)
        for j in range(k):
            total = total * U(_BASE) + hashes[j : j + len(total)]
        return mix(total + U(k))


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted, and each one's first index.

    Fewer than k words: the whole sequence is the one shingle. No words: none.
    """
    n_words = np.diff(first)
    whole = np.flatnonzero((n_words > 0) & (n_words < k))
    rolled, owner = rolling(hashes, k), owners(first)
    at = np.flatnonzero(np.arange(len(hashes)) + k <= first[1:][owner])
    made, docs = [rolled[at]], [owner[at]]
    for n in range(1, k):
        short = whole[n_words[whole] == n]
        if len(short):
            made.append(rolling(hashes, n)[first[short]])
            docs.append(short)
    made, docs = np.concatenate(made), np.concatenate(docs)
    order = np.lexsort((made, docs))
    made, docs = made[order], docs[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (docs[1:] != docs[:-1])
    made, docs = made[new], docs[new]
    return made, np.searchsorted(docs, np.arange(len(first)))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each document's items (zero for none); unsigned integers wrap."""
    with np.errstate(over="ignore"):
        total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
        np.cumsum(values, axis=0, out=total[1:])
        return total[first[1:]] - total[first[:-1]]


def code_points_before(data: np.ndarray, at: np.ndarray, start: int) -> np.ndarray:
    """For byte places at in data, how many code points lie between start and each."""
    count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return count[at] - count[start]


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each document."""
    return sums(((data & 0xC0) != 0x80).astype(np.int64), offsets)
