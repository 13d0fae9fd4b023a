"""Words and word windows of Arrow string columns as arrays of 64-bit hashes.

A whole Arrow batch is hashed by a few numpy passes over its bytes: no Python object is made per word. A word's hash is a
polynomial over random byte values modulo 2**64 with an odd base, mixed afterwards; equal words have equal hashes in
every process, and windows hash their word hashes. Two different items collide with a probability of about 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, 2 * CHUNK_BYTES)
        table = np.full(size, np.uint64(base & (2**64 - 1)))
        table[0] = 1
        table = np.multiply.accumulate(table)
        _powers[base] = table
    return table[:n]


_BASE = 0xD6E8FEB86659FD93 | 5
_INVERSE = pow(_BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix finalizer."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of consecutive texts: hashes, byte places in ``data``, and where each text's words begin."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def hash_words(data: np.ndarray, offsets: np.ndarray, fold_case: bool) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; offsets[0] is 0."""
    n = len(data)
    if fold_case:
        data = _FOLD[data]
    inside = ~_BLANK[data]
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | breaks[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | breaks[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power_table(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power_table(_INVERSE, n + 1)[starts]
    return Words(data, mix(h + (ends - starts).astype(np.uint64)), starts, ends, np.searchsorted(starts, offsets))


def text_chunks(column: pa.Array, fold_case: bool) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for runs of rows of a string column; null texts have no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, to, hash_words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], fold_case)
        at = to


def window_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of ``width`` words inside one text."""
    n = len(words.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= np.uint64(_ODD)
        h += words.hashes[k : k + n]
    owner = words.owner
    whole = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(h[whole] + np.uint64(width)), whole
