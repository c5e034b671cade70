"""Words and Rabin-Karp hashes of whole Arrow string columns, in numpy.

A word is a maximal run of bytes outside space and 0x09-0x0D; in UTF-8 that is
the same as a run of code points outside those six.  Hashes are polynomials
modulo 2**64 with an odd base: first over the bytes of each word, then, after a
mixing step, over the words of each window.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole value."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words(NamedTuple):
    """data: bytes of all texts; at: byte offsets of texts; start, end: of words; of: word offsets of texts."""

    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without copying, and the offsets of its rows; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n, buffers = len(texts), texts.buffers()
    at = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    data, at = raw(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]  # words end with their text
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def word_hashes(w: Words) -> np.ndarray:
    if not len(w.start):
        return np.zeros(0, U64)
    length = w.end - w.start
    power = powers(_BYTE_BASE, int(length.max()))
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    total = np.zeros(len(within) + 1, U64)
    np.cumsum((w.data[np.repeat(w.start, length) + within].astype(U64) + U64(1)) * power[within], out=total[1:])
    edge = np.concatenate([[0], np.cumsum(length)])
    return mix(total[edge[1:]] - total[edge[:-1]] + length.astype(U64) * U64(_WORD_BASE))


def windows(hashes: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every k consecutive words of one text, and the window offsets of the texts.

    The window at word i of a text is number of[text] - (k - 1) * (texts before with k words or more) + i.
    """
    counts = np.diff(of)
    full = np.maximum(counts - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(full)])
    if not first[-1]:
        return np.zeros(0, U64), first
    n = len(hashes)
    total = np.zeros(n + 1, U64)
    np.cumsum(hashes * powers(_WORD_BASE, n), out=total[1:])
    i = np.arange(first[-1]) + np.repeat(of[:-1] - first[:-1], full)
    inverse = powers(pow(_WORD_BASE, -1, 1 << 64), n)
    return mix((total[i + k] - total[i]) * inverse[i]), first


def sequence_hashes(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One hash for the whole word sequence of each text."""
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(_WORD_BASE, len(hashes)), out=total[1:])
    inverse = powers(pow(_WORD_BASE, -1, 1 << 64), len(hashes) + 1)
    return mix((total[of[1:]] - total[of[:-1]]) * inverse[of[:-1]] + np.diff(of).astype(U64))


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles of the lower-cased texts, ascending in each text, and their offsets.

    A text of fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    w = words_of(texts, lower=True)
    hashes = word_hashes(w)
    value, first = windows(hashes, w.of, k)
    counts = w.counts
    few = np.flatnonzero((counts > 0) & (counts < k))
    doc = np.repeat(np.arange(len(counts)), np.diff(first))
    if len(few):
        value = np.concatenate([value, sequence_hashes(hashes, w.of)[few]])
        doc = np.concatenate([doc, few])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], np.searchsorted(doc[keep], np.arange(len(counts) + 1))


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows with about `most` bytes of text each (one longer text stays whole), so that arrays stay small."""
    _, at = raw(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
