"""Removal of repeated word windows by level-wise doubling.

A window of ``width`` words can repeat only if the shorter windows inside it repeat. The first level looks at windows of about
half the width, and of those only at the one with the least hash inside each full window, which two equal windows choose
alike. What repeats in another document is extended to twice the length, and so on up to ``width``, where a window counts
if a document with a smaller id has it too. Each level sends one row per (window hash, chunk of documents): copies that
meet inside a chunk are settled there, so a passage of very many documents is few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convsignals.llm.hashing import Words, text_chunks, window_hashes
from convsignals.llm.tables import released

WIDTH = 13


def levels(width: int) -> list[int]:
    """Lengths of the levels: doubling up to ``width``, the first at least a quarter of it and not above 7."""
    out = [width]
    while out[0] > 7:
        out.insert(0, -(-out[0] // 2))
    return out


def _least(words: Words, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every full window, and the least hash of the windows of ``length`` words inside it."""
    _, at = window_hashes(words, width)
    if length == width or not len(at):
        return at, window_hashes(words, width)[0]
    h, place = window_hashes(words, length)
    full = np.full(len(words.hashes), np.iinfo(np.uint64).max, np.uint64)
    full[place] = h
    least = full[at]
    for k in range(1, width - length + 1):
        np.minimum(least, full[at + k], out=least)
    return at, least


def _member(owner: np.ndarray, h: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each hash is in the list of its owner."""
    ends = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    whose = np.repeat(np.arange(len(ends)), ends)
    # Pairs (owner, hash) compare as one number after ranking the hashes.
    ranks = np.unique(values)
    if not len(ranks):
        return np.zeros(len(h), bool)
    r = np.minimum(np.searchsorted(ranks, h), len(ranks) - 1)
    known = np.unique(whose * len(ranks) + np.searchsorted(ranks, values))
    key = owner * len(ranks) + r
    return (ranks[r] == h) & (known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)


def _level(width: int, before: int | None, length: int):
    """Rows (hash, doc, settled) of the candidate windows of each chunk at one level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, words in text_chunks(b.column(1), False):
                at, h = _least(words, width, length)
                own = words.owner[at]
                if before is not None and len(at):
                    keep = _member(own, _least(words, width, before)[1], b.column(2)[lo:hi])
                    own, h = own[keep], h[keep]
                doc = ids[lo:hi][own]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[new], doc[new]
                head = np.ones(len(h), bool)
                head[1:] = h[1:] != h[:-1]
                shared = ~head
                if length < width:  # the smallest document repeats as well
                    shared[:-1] |= ~head[1:]
                yield pa.RecordBatch.from_pydict(
                    {
                        "hash": pa.array(np.concatenate([h[head], h[shared]]).view(np.int64)),
                        "doc": pa.array(np.concatenate([doc[head], doc[shared]])),
                        "settled": pa.array(np.concatenate([np.zeros(head.sum(), bool), np.ones(shared.sum(), bool)])),
                    }
                )

    return run


def _answer(final: bool):
    """The settled rows, and of the others those whose hash another document has; at the last level a smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            h, doc, settled = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            if settled.any():
                yield pa.RecordBatch.from_pydict({"hash": pa.array(h[settled]), "doc": pa.array(doc[settled])})
            parts.append((h[~settled], doc[~settled]))
        if not parts:
            return
        h, doc = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        least = doc[np.flatnonzero(head)][np.cumsum(head) - 1] if len(h) else doc
        later = doc > least
        if not final:
            some = np.zeros(len(h), bool)
            np.logical_or.at(some, np.cumsum(head)[later] - 1, True)
            later = some[np.cumsum(head) - 1] if len(h) else later
        yield pa.RecordBatch.from_pydict({"hash": pa.array(h[later]), "doc": pa.array(doc[later])})

    return run


def _cut(width: int):
    """(doc_id, n_words, n_removed, kept_sha256) of each text, given the hashes of its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words in text_chunks(b.column(1), False):
                lists = b.column(2)[lo:hi]
                gone = np.zeros(len(words.hashes) + 1, np.int64)
                if lists.null_count < len(lists):
                    h, at = window_hashes(words, width)
                    hit = at[_member(words.owner[at], h, lists)]
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + width, -1)
                gone = np.cumsum(gone)[:-1] > 0
                digests = []
                data = words.data.tobytes()
                for k in range(hi - lo):
                    a, z = words.first[k], words.first[k + 1]
                    if a == z:
                        kept = b""
                    elif gone[a:z].any():
                        left = np.flatnonzero(~gone[a:z]) + a
                        kept = b" ".join([data[s:e] for s, e in zip(words.starts[left], words.ends[left])])
                    else:
                        kept = b" ".join(data[words.starts[a] : words.ends[z - 1]].split())
                    digests.append(hashlib.sha256(kept).hexdigest())
                removed = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": b.column(0)[lo:hi],
                        "n_words": pa.array(words.counts.astype(np.int64)),
                        "n_removed": pa.array(removed[words.first[1:]] - removed[words.first[:-1]]),
                        "kept_sha256": pa.array(digests, pa.string()),
                    }
                )

    return run


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, hashes): per document the hashes of its windows that also start in a document with a smaller id."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists, before = None, None
    for length in levels(width):
        source = docs if lists is None else docs.join(lists, "doc_id").select("doc_id", "text", "hashes")
        rows = source.mapInArrow(_level(width, before, length), "hash long, doc long, settled boolean")
        # Settled rows pass through by document, so that they do not meet at their hash.
        dealt = rows.repartition(parts, F.when(F.col("settled"), F.col("doc")).otherwise(F.col("hash")))
        told = dealt.mapInArrow(_answer(length == width), "hash long, doc long")
        lists = released(told.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("hash").alias("hashes")))
        before = length
    return lists


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Words of every text without those inside windows that an earlier document has.

    Returns doc_id, n_words, n_removed (long), kept_sha256: the kept words joined by one space. Words are runs of
    ``[^\\x20\\x09-\\x0D]``, unchanged; a null, empty or short text has no window and loses nothing. Windows are judged on the
    input. Rows that share an id count as one document in the comparison and keep what only they have; a row with a null
    id neither removes nor loses anything. Repeated rows stay; an empty table gives an empty result; other columns are
    not read. Windows are compared by a 64-bit hash.
    """
    docs = docs.select("doc_id", "text")
    found = docs.join(repeated_windows(docs, width), "doc_id", "left").select("doc_id", "text", "hashes")
    return found.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")
