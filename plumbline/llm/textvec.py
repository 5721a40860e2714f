"""Vectorised tokens over Arrow binary columns.

The operators of this package receive whole texts as UTF-8 bytes.  A batch is cut into chunks of a
few megabytes (never inside a document), so that the temporary arrays stay bounded whatever the
Arrow batch size is.  Nulls are turned into empty texts before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_U = np.uint64


def _lut(values) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


#: The six separators of the word contract: space and the controls 09 to 0D.
SPACE = _lut([0x20, *range(0x09, 0x0E)])
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
KEEP = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def stream(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(0x100000001B3)) * _U(0x9E3779B97F4A7C15))


_PLACES = stream(256, 11) | _U(1)


def places(n: int) -> np.ndarray:
    """A multiplier for each position in a word; grows with the longest word seen."""
    global _PLACES
    if len(_PLACES) < n:
        _PLACES = stream(2 * n, 11) | _U(1)
    return _PLACES


def doc_chunks(column: pa.Array | pa.ChunkedArray, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of whole documents."""
    for first, array in _arrays(column):
        n = len(array)
        kind = np.int64 if pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type) else np.int32
        _, at, body = array.buffers()
        offsets = np.frombuffer(at, dtype=kind)[array.offset : array.offset + n + 1].astype(np.int64)
        data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1)
            yield first + i, first + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def _arrays(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    first = 0
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(array):
            yield first, array
        first += len(array)


class Words:
    """The words of a chunk: where each starts and ends, and how many each document has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER, gaps: np.ndarray = SPACE):
        self.text = fold[data]
        self.offsets = offsets
        gap = gaps[self.text]
        solid = ~gap
        n = len(data)
        if n:
            nonempty = offsets[:-1][np.diff(offsets) > 0]
            edge = np.zeros(n + 1, dtype=bool)
            edge[nonempty] = True
            edge[n] = True
            before = np.empty(n, dtype=bool)
            before[0] = True
            before[1:] = gap[:-1]
            after = np.empty(n, dtype=bool)
            after[-1] = True
            after[:-1] = gap[1:]
            self.starts = np.flatnonzero(solid & (before | edge[:-1]))
            self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        self.solid = solid
        #: words of document d are first[d] : first[d + 1]
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        if not len(self.starts):
            return np.zeros(0, dtype=_U)
        lengths = self.ends - self.starts
        at = np.flatnonzero(self.solid)
        begins = np.zeros(len(lengths), dtype=np.int64)
        np.cumsum(lengths[:-1], out=begins[1:])
        inside = np.arange(len(at)) - np.repeat(begins, lengths)
        terms = (self.text[at].astype(_U) + _U(1)) * places(int(lengths.max()))[inside]
        return mix(np.add.reduceat(terms, begins) + lengths.astype(_U))

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def windows(hashes: np.ndarray, first: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each document, and where each document's begin.

    A document with fewer words, but not none, has one window: all its words.
    """
    weights = stream(size, seed) | _U(1)
    counts = np.diff(first)
    n = len(hashes)
    if n >= size:
        sums = hashes[: n - size + 1] * weights[0]
        for k in range(1, size):
            sums = sums + hashes[k : n - size + 1 + k] * weights[k]
    else:
        sums = np.zeros(0, dtype=_U)
    held = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(held) + 1, dtype=np.int64)
    np.cumsum(held, out=begin[1:])
    out = np.empty(begin[-1], dtype=_U)
    full = counts >= size
    where = np.arange(begin[-1]) - np.repeat(begin[:-1], held) + np.repeat(first[:-1], held)
    whole = np.repeat(full, held)
    out[whole] = sums[where[whole]]
    for d in np.flatnonzero(~full & (counts > 0)):
        h = hashes[first[d] : first[d + 1]]
        out[begin[d]] = (h * weights[: len(h)]).sum(dtype=_U) + _U(len(h)) * _U(0x51ED270B)
    return mix(out), begin
