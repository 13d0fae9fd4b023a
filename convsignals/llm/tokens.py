"""Tokens of Arrow string columns under any byte classes, their strings, and helpers for arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convsignals.llm.hashing import Words, hash_words, mix

#: Bytes of text that are counted together; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
BLANK = 0x20


def byte_table(separators: Iterator[int]) -> np.ndarray:
    """Byte map that lower-cases A-Z and turns separators into blanks.

    Every byte of a character beyond ASCII is 0x80 or more, so ASCII classes can be told by bytes.
    """
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = BLANK
    return table


def token_chunks(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """(from, to, tokens, bytes as they were) for runs of rows of a string column; null texts have no tokens."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        raw = data[offsets[at] : offsets[to]]
        yield at, to, hash_words(table[raw], offsets[at : to + 1] - offsets[at], False), raw
        at = to


def strings(words: Words, which: np.ndarray) -> pa.Array:
    """Tokens number ``which`` as an Arrow string array."""
    start, length = words.starts[which], words.ends[which] - words.starts[which]
    offsets = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    data = words.data[at] if len(at) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def fold(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + other)


def hash_order(h: np.ndarray) -> np.ndarray:
    """Stable order by hash: one sort of keys that hold the upper bits of the hash and the place."""
    bits = np.uint64(max(len(h) - 1, 1).bit_length())
    key = np.sort((h >> bits << bits) | np.arange(len(h), dtype=np.uint64))
    order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    upper = key >> bits
    if len(h) > 1 and ((upper[1:] == upper[:-1]) & (h[order[1:]] != h[order[:-1]])).any():
        return np.argsort(h, kind="stable")
    return order


def edges(*keys: np.ndarray) -> np.ndarray:
    """Whether each place of sorted keys begins a new run."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


#: Bits of the largest filter: 16 MB, whatever it stands for.
MOST_BITS = 1 << 27


def hash_filter(df: DataFrame, column: str) -> np.ndarray:
    """Bits at hash modulo size for every value of a long column, as 64-bit words.

    A value without its bit is surely absent. The size follows the number of rows up to MOST_BITS, beyond which more
    values pass that are absent; callers must not rely on presence.
    """
    size = min(MOST_BITS, max(1 << 16, 1 << (16 * df.count()).bit_length()))
    at = F.pmod(F.col(column), F.lit(size))
    slot, bit = F.expr("at div 64"), F.expr("shiftleft(1L, cast(at % 64 as int))")
    rows = df.select(at.alias("at")).select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def passes(filter_words: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(64 * len(filter_words) - 1)
    return (filter_words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def text_partitions(docs: DataFrame, bytes_each: int = 24 << 20) -> int:
    """Partitions for rows made of the words of all texts, so that one holds about the words of ``bytes_each``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))
