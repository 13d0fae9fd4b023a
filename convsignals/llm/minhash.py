"""Near duplicates by an inverted join of MinHash signatures.

Documents are posted under each coordinate of their signature together with its value. Postings that no other document
shares fall away, and with them every document that has fewer than the threshold left. The rest of a document's postings are
put in order, rarest first: two documents that share ``least`` of them share one of the first ``len - least + 1``, so only this
prefix is posted again, with the signature, and collisions are counted inside each list. The merge of a list skips what
cannot give a new link: a document in the largest part of a list is not asked again. Parts of linked candidates become regions,
whose documents are compared on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convsignals.llm.components import connected_components
from convsignals.llm.hashing import mix
from convsignals.llm.jaccard_join import BLOCK, BLOCK_SHINGLES, _across, _joined, _scan, _sets, _shipped, _sum_by
from convsignals.llm.tables import released
from convsignals.llm.tokens import edges
from convsignals.operators.blocks import lookup_join

#: Coordinates of a signature.
COORDINATES = 48
#: A linked pair misses the match threshold with at most this probability.
MISS = 1e-9
#: Lists up to this size are compared pair by pair, larger ones document by document against the rest.
SMALL_LIST = 12
#: Documents of a list that one task compares; longer lists are cut, and their parts meet afterwards.
LIST_BLOCK = 4000
_seeds = np.random.default_rng(20240813)
_ODD = _seeds.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def match_threshold(coordinates: int, percent: int, miss: float = MISS) -> int:
    """Most matches that all but a share of ``miss`` of the pairs at the similarity ``percent`` reach."""
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            return max(k, 1)
    return coordinates


def signatures(docs: DataFrame, width: int, coordinates: int = COORDINATES) -> DataFrame:
    """Per document: n (shingles), a and b (a digest of its set), sig: ``coordinates`` least hashes as 32-bit numbers."""

    def work(ids, words):
        own, h, _ = _sets(words, width)
        n = np.bincount(own, minlength=len(ids))
        a = _sum_by(own, mix(h ^ np.uint64(0x5851F42D4C957F2D)), len(ids)).view(np.int64)
        b = _sum_by(own, mix(h + np.uint64(0x14057B7EF767814F)), len(ids)).view(np.int64)
        some = np.flatnonzero(n)
        first = np.searchsorted(own, some)
        sig = np.zeros((len(ids), coordinates), np.uint32)
        for k in range(coordinates if len(some) else 0):
            sig[some, k] = np.minimum.reduceat((h * _ODD[k]) >> np.uint64(20), first) & np.uint64(0xFFFFFFFF)
        body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * coordinates), len(ids), [None, pa.py_buffer(sig.tobytes())])
        return {"doc_id": pa.array(ids), "n": pa.array(n.astype(np.int64)), "a": pa.array(a), "b": pa.array(b), "sig": body.cast(pa.binary())}

    return _scan(docs, work, "doc_id long, n long, a long, b long, sig binary")


def _matrix(bodies: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(bodies.to_pylist()), np.uint32).reshape(-1, coordinates)


def _keys(sig: np.ndarray) -> np.ndarray:
    """Posting keys of signatures: a hash of coordinate and value."""
    place = np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32)
    return mix(sig.astype(np.uint64) + place + np.uint64(1)).view(np.int64)


def postings(reps: DataFrame, coordinates: int) -> DataFrame:
    """(key, doc_id) for every coordinate of (doc_id, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _keys(_matrix(b.column(1), coordinates))
            ids = np.repeat(b.column(0).to_numpy(), coordinates)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()), "doc_id": pa.array(ids)})

    return reps.select("doc_id", "sig").mapInArrow(run, "key long, doc_id long")


def prefixes(reps: DataFrame, least: int, coordinates: int) -> DataFrame:
    """(key, held, doc_id, sig): each document under its rarest shared postings, as many as a partner cannot avoid."""
    posted = postings(reps, coordinates)
    lists = released(posted.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1").withColumn("weight", F.col("held")))
    shared = lookup_join(posted, lists, "key", "weight", how="inner", row_id="doc_id")
    mine = shared.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("row")).filter(F.size("row") >= least)
    cut = mine.select("doc_id", F.slice("row", 1, F.size("row") - F.lit(least - 1)).alias("row"))
    return cut.join(reps.select("doc_id", "sig"), "doc_id").select(F.explode("row").alias("at"), "doc_id", "sig").select("at.key", "at.held", "doc_id", "sig")


def _retained(sig: np.ndarray, least: int) -> list[tuple[np.ndarray, int]]:
    """(members, pivot) pairs of a list with at least ``least`` equal coordinates, enough of them to join its parts.

    Each part that a pivot meets gives one member, so a list of n documents gives at most n - 1 pairs.
    """
    comp = np.arange(len(sig))
    done = np.zeros(len(sig), bool)
    out = []
    while True:
        left = np.flatnonzero(~done & (comp != np.bincount(comp).argmax()))
        if not len(left):
            return out
        p = int(left[0])
        other = np.flatnonzero(comp != comp[p])
        hit = other[(sig[other] == sig[p]).sum(1) >= least]
        if len(hit):
            out.append((hit[np.unique(comp[hit], return_index=True)[1]], p))
            comp[np.isin(comp, comp[hit])] = comp[p]
        done[p] = True


def _count_lists(least: int, coordinates: int):
    """Retained pairs (a, b) of the lists in a partition; rows (key, part, doc_id, sig) are sorted by list."""

    def compare(doc, sig, start, size):
        pairs = []
        for s in range(2, SMALL_LIST + 1):
            at = start[size == s]
            for i in range(s):
                for j in range(i + 1, s):
                    hit = at[(sig[at + i] == sig[at + j]).sum(1) >= least]
                    pairs.append((doc[hit + i], doc[hit + j]))
        for x, s in zip(start[size > SMALL_LIST], size[size > SMALL_LIST]):
            for members, p in _retained(sig[x : x + s], least):
                pairs.append((doc[x + members], np.full(len(members), doc[x + p])))
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*pairs)) or ([], [])))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = [*(b.column(k).to_numpy() for k in range(3)), _matrix(b.column(3), coordinates)]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows)]
            if not len(rows[0]):
                continue
            start = np.flatnonzero(edges(rows[0], rows[1]))
            last = start[-1]
            # The last list may go on in the next batch.
            if last:
                yield compare(rows[2][:last], rows[3][:last], start[:-1], np.diff(start))
            held = [c[last:] for c in rows]
        if held is not None:
            yield compare(held[2], held[3], np.zeros(1, np.int64), np.array([len(held[2])]))

    return run


def candidates(reps: DataFrame, percent: int, coordinates: int = COORDINATES) -> DataFrame:
    """Edges (a, b) between documents (doc_id, sig) that join all pairs above the match threshold into parts.

    Every edge is such a pair, except inside lists of more than LIST_BLOCK documents, which are cut into parts that
    meet as the blocks of a region do.
    """
    least = match_threshold(coordinates, percent)
    spark = reps.sparkSession
    rows = released(prefixes(reps, least, coordinates))
    total = rows.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 400_000))
    blocks = F.ceil(F.col("held") / LIST_BLOCK)
    cut = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), blocks)).select("key", "part", "doc_id", "sig")
    dealt = cut.repartition(n, "key", "part").sortWithinPartitions("key", "part", "doc_id")
    links = released(dealt.mapInArrow(_count_lists(least, coordinates), "a long, b long").distinct())
    long = rows.filter(F.col("held") > LIST_BLOCK)
    if long.take(1):
        # Signatures are sets of coordinate and value here; equal coordinates over the union is their Jaccard similarity.
        def as_set(batches):
            for b in batches:
                keys = np.sort(_keys(_matrix(b.column(3), coordinates)), axis=1)
                body = pa.array([k.tobytes() for k in keys], pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(2), "region": b.column(0), "blocks": b.column(1), "body": body})

        sets = long.select("key", blocks.cast("long").alias("blocks"), "doc_id", "sig").mapInArrow(as_set, "doc_id long, region long, blocks long, body binary")
        links = links.union(_across(released(sets), links, 100 * least // (2 * coordinates - least)).select("a", "b"))
    return links


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, coordinates: int = COORDINATES) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= ``percent`` * union.

    Returns doc_id, n_shingles (long), component_id: the smallest doc_id that links reach, itself included, and kept: whether
    that is the document itself. Letters A-Z are folded, words are runs of ``[^\\x20\\x09-\\x0D]``; a text with fewer words than
    ``width`` has one shingle, its whole sequence; a text without words (or a null) has none and links with nothing. Links
    are confirmed on full sets; a link is missed only if fewer coordinates match than the threshold, with a probability of at
    most MISS. A row with a null doc_id takes no part in links, has a null component and is kept. Rows that share an id share
    a component. Repeated rows stay. An empty table gives an empty result. Only doc_id and text are read.
    """
    docs = docs.select("doc_id", "text")
    nameless, docs = docs.filter("doc_id is null"), docs.filter("doc_id is not null")
    slim = released(signatures(docs, width, coordinates))
    keyed = slim.filter("n > 0").withColumn("set", F.concat_ws(":", "n", "a", "b"))
    # Equal sets are one class, spoken for by its smallest id.
    classes = keyed.groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    member = released(lookup_join(keyed, released(classes), "set", "copies", how="inner", row_id="doc_id").select("doc_id", "rep", "n", "sig"))
    # Smaller sets link with equal sets only.
    smallest = next(n for n in range(1, 1000) if 100 * (n - 1) >= percent * n)
    reps = member.filter(F.col("n") >= smallest - 1).filter("doc_id = rep").groupBy("doc_id").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = released(reps)
    regions = released(connected_components(candidates(reps, percent, coordinates)))
    weights = regions.join(reps.select(F.col("doc_id").alias("node"), "n"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    sizes = weights.groupBy("component").agg(blocks.alias("blocks"))
    labels = regions.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("region"), "blocks")
    sets = released(_shipped(docs, labels, width))
    mine = F.to_json(F.struct("region", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block")))
    links = released(_joined(sets.withColumns({"key": mine, "visitor": F.lit(False)}), percent, False)).filter("a <> b")
    if sets.filter("blocks > 1").take(1):
        links = links.union(_across(sets, links, percent))
    copies = member.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links.select("a", "b").union(copies)).withColumnRenamed("node", "doc_id")
    out = slim.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    blank = signatures(nameless.select(F.lit(0).cast("long").alias("doc_id"), "text"), width, 1)
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.union(blank.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
