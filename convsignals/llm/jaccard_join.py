"""Exact Jaccard join of documents over word shingles, as a join in a metric space.

One minus the Jaccard similarity is a metric, so distances to pivots bound distances between documents. Documents are first
gathered into regions: linked documents share one of their first shingles in a common order (longest first, frequent ones
last), so the holders of such a shingle are searched. A pivot among them takes those into its region that the triangle
inequality allows to link: it bounds a distance from below by sizes (distance to the empty set) and by the counts
of shingles in parts of the universe, more parts for larger sets. Holders that may link stay together, and regions that touch become one. Inside a region
the join is recursive: pivots are taken one after another among documents whose links are still open, each splits its
region by the triangle inequality into the window that may hold links and the rest, and documents of one component
are not compared again. Large regions are cut into blocks that are joined apart; then only documents outside the largest
component visit the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from convsignals.llm.components import connected_components
from convsignals.llm.hashing import Words, mix, text_chunks, window_hashes
from convsignals.llm.tables import Scratch, released
from convsignals.operators.blocks import lookup_join

PARTS = 64
#: (least set, parts): random sets of n shingles differ by about sqrt(n * parts) in their counts, links at most by a share of n, so
#: the bound is blunt where the parts are few for n. Each number of parts divides the next.
LEVELS = ((0, PARTS), (300, 256), (1500, 1024), (12_000, 4096))
#: Shingles that are left to the end of the common order; any set of them gives the same links.
FREQUENT = 50_000
#: Holder groups up to this size are compared pair by pair, larger ones by pivots.
SMALL_GROUP = 16
#: Larger holder groups than this become one region without a look at their bounds.
LARGE_GROUP = 20_000
#: Rows that a task gives out at once.
MEET_ROWS = 50_000
#: Documents, and shingles of them all, of a region that one task joins.
BLOCK, BLOCK_SHINGLES = 2000, 1_500_000


def _sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, length in bytes) of the distinct shingles of each text, sorted by owner and hash.

    A text with fewer words than ``width`` has one shingle, its whole sequence.
    """
    h, at = window_hashes(words, width)
    own = words.owner[at]
    size = words.ends[at + width - 1] - words.starts[at]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    extra = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        live = counts[short] > k
        extra[live] = extra[live] * np.uint64(0x9E3779B97F4A7C15) + words.hashes[words.first[short[live]] + k]
    extra = mix(extra + counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    own, h, size = np.concatenate([own, short]), np.concatenate([h, extra]), np.concatenate([size, counts[short] * 0 + 1])
    order = np.lexsort((h, own))
    own, h, size = own[order], h[order], size[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return own[new], h[new], size[new]


def _sum_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of unsigned values (modulo 2**64) of each owner 0..n-1; owners are sorted."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    edge = np.searchsorted(owner, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def _scan(docs: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow over (doc_id, text): ``work(ids, words)`` gives columns for each chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, words in text_chunks(b.column(1), True):
                out = work(ids[lo:hi], words)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(run, schema)


def _level(n: np.ndarray) -> np.ndarray:
    """Place in LEVELS of sets of these sizes."""
    return np.searchsorted([least for least, _ in LEVELS], n, "right") - 1


def _counts(owner: np.ndarray, h: np.ndarray, chosen: np.ndarray, parts: int) -> np.ndarray:
    """Count vectors, in this many parts, of the ``chosen`` sets; owners are numbers of sets."""
    place = np.cumsum(chosen) - 1
    mine = chosen[owner]
    at = place[owner[mine]] * parts + (h[mine].view(np.uint64) % np.uint64(parts)).astype(np.int64)
    return np.bincount(at, minlength=int(chosen.sum()) * parts).reshape(-1, parts)


def _packed(owner: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Count vector of each set at its level, a byte a part, or two where a count needs them."""
    level, out = _level(n), [b""] * len(n)
    for k, (_, parts) in enumerate(LEVELS):
        for i, v in zip(np.flatnonzero(level == k), _counts(owner, h, level == k, parts)):
            out[i] = v.astype(np.uint8 if v.max() < 256 else np.uint16).tobytes()
    return out


def _places(level: np.ndarray) -> list[np.ndarray]:
    """Row of each set in the vectors of each level, -1 where it has none there."""
    return [np.where(level >= k, np.cumsum(level >= k) - 1, -1) for k in range(len(LEVELS))]


def _may_link(
    vecs: list[np.ndarray], n: np.ndarray, p: int, percent: int, among: np.ndarray | None = None, places: list[np.ndarray] | None = None
) -> np.ndarray:
    """Members, of those ``among`` that are asked about, that the bounds allow to link with member ``p``.

    A link's symmetric difference is at most (1 - s) / (1 + s) of the sum of both sizes, and at least the distance
    of the count vectors. ``places`` has the rows of members in each of ``vecs``; without it all have one, in order.
    """
    fit = np.minimum(n, n[p]) * 100 >= percent * np.maximum(n, n[p])
    some = np.flatnonzero(fit if among is None else fit & among)
    for vec, place in zip(vecs, places or [np.arange(len(n))] * len(vecs)):
        if place[p] < 0:
            break
        at = place[some]
        close = at < 0
        apart = np.abs(vec[at[~close]].astype(np.int32, copy=False) - vec[place[p]].astype(np.int32)).sum(1)
        close[~close] = apart * (100 + percent) <= (100 - percent) * (n[some[~close]] + n[p])
        some = some[close]
    out = np.zeros(len(n), bool)
    out[some] = True
    return out


def _merge(comp: np.ndarray, members: np.ndarray) -> None:
    labels = np.unique(comp[members])
    if len(labels) > 1:
        comp[np.isin(comp, labels)] = labels[0]


def _gathered(vecs: list[np.ndarray], n: np.ndarray, percent: int, places: list[np.ndarray] | None = None) -> np.ndarray:
    """Label (first member) of the parts of a group between which no link is possible."""
    comp = np.arange(len(n))
    done = np.zeros(len(n), bool)
    while True:
        # What may link with the largest part is found from the other side. Which part that is changes: no member is
        # passed over for good before all that were not asked lie in the largest part of the end.
        left = np.flatnonzero(~done & (comp != np.bincount(comp, minlength=1).argmax()))
        if not len(left):
            return comp
        p = left[0]
        _merge(comp, np.append(np.flatnonzero(_may_link(vecs, n, p, percent, places=places)), p))
        done[p] = True


def _threshold_prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (-(-percent * n // 100)) + 1


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Per document: n_shingles, a 128-bit digest of its set, counts by part; and rows (hash) of locally frequent shingles."""

    def work(ids, words):
        own, h, _ = _sets(words, width)
        n = np.bincount(own, minlength=len(ids))
        a = _sum_by(own, mix(h ^ np.uint64(0x5851F42D4C957F2D)), len(ids)).view(np.int64)
        b = _sum_by(own, mix(h + np.uint64(0x14057B7EF767814F)), len(ids)).view(np.int64)
        _, first = np.unique(a, return_index=True)
        distinct = np.isin(own, first)
        often, c = np.unique(h[distinct], return_counts=True)
        often = often[c >= 4].view(np.int64)
        m = len(often)
        return {
            "doc_id": pa.array(np.concatenate([ids, np.zeros(m, np.int64)])),
            "n": pa.array(np.concatenate([n, np.full(m, -1)]).astype(np.int64)),
            "a": pa.array(np.concatenate([a, often])),
            "b": pa.array(np.concatenate([b, np.zeros(m, np.int64)])),
            "vec": pa.array([*_packed(own, h, n), *[None] * m], pa.binary()),
        }

    return _scan(docs, work, "doc_id long, n long, a long, b long, vec binary")


def _first_shingles(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(hash, doc): each document with its first shingles in the common order.

    All holders ask on, but for equal sets of a chunk: the bounds are not transitive, so no document can stand for its like.
    """
    least = next(n for n in range(1, 1000) if 100 * (n - 1) >= percent * n)  # smaller sets link with equal sets only

    def work(ids, words):
        own, h, size = _sets(words, width)
        n = np.bincount(own, minlength=len(ids))
        a = _sum_by(own, mix(h ^ np.uint64(0x5851F42D4C957F2D)), len(ids))
        keep = np.zeros(len(ids), bool)  # one of the equal sets in the chunk, that with the smallest id
        order = np.lexsort((ids, a))
        keep[order[np.concatenate([[True], a[order][1:] != a[order][:-1]])]] = True if len(ids) else False
        late = np.isin(h, frequent) if len(frequent) else np.zeros(len(h), bool)
        order = np.lexsort((h, -size, late, own))
        own, h = own[order], h[order]
        rank = np.arange(len(own)) - np.searchsorted(own, np.arange(len(ids)))[own]
        use = (rank < _threshold_prefix(n, percent)[own]) & (n[own] >= least - 1) & keep[own]
        return {"hash": pa.array(h[use].view(np.int64)), "doc": pa.array(ids[own[use]])}

    return _scan(docs, work, "hash long, doc long")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holders of each shingle of a partition: pairs (x, y) of small groups (group null), and (group, x) of larger ones."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    h, doc = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
    start, count = edge[:-1], np.diff(edge)
    docs, place = np.unique(doc, return_inverse=True)
    # A pair of small groups is one number: the places of its two documents.
    pairs, groups, stars = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for size in range(2, SMALL_GROUP + 1):
        at = start[count == size]
        for i in range(size):
            for j in range(i + 1, size):
                pairs.append(np.unique(place[at + i] * len(docs) + place[at + j]))
    for a, c in zip(start[count > SMALL_GROUP], count[count > SMALL_GROUP]):
        if c > LARGE_GROUP:
            stars.append(np.stack([np.full(c - 1, doc[a]), doc[a + 1 : a + c]], 1))
        else:
            groups.append(np.stack([np.full(c, h[a]), doc[a : a + c]], 1))
    def rows(x, y, open_, group):
        for k in range(0, len(x), MEET_ROWS):
            to = slice(k, k + MEET_ROWS)
            columns = {"x": pa.array(x[to]), "y": pa.array(y[to]), "open": pa.array(np.full(len(x[to]), open_))}
            named = pa.nulls(len(x[to]), pa.int64()) if group is None else pa.array(group[to])
            yield pa.RecordBatch.from_pydict(columns | {"group": named})

    code = np.unique(np.concatenate(pairs))
    del pairs
    for k in range(0, len(code), MEET_ROWS):
        some = code[k : k + MEET_ROWS]
        yield from rows(docs[some // len(docs)], docs[some % len(docs)], True, None)
    z, g = np.unique(np.concatenate(stars), axis=0), np.concatenate(groups)
    yield from rows(z[:, 0], z[:, 1], False, None)
    yield from rows(g[:, 1], g[:, 1], False, g[:, 0])


def _columns(vec: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Level of each packed vector, and for each level the vectors of the rows that have it, summed to its parts."""
    width = pc.binary_length(vec).to_numpy(zero_copy_only=False)
    level = np.zeros(len(vec), np.int64)
    own = {}
    for k, (_, parts) in enumerate(LEVELS):
        for size, kind in ((parts, np.uint8), (2 * parts, np.uint16)):
            if (rows := np.flatnonzero(width == size)).size:
                level[rows] = k
                own[rows.tobytes()] = (rows, np.frombuffer(b"".join(vec.take(pa.array(rows)).to_pylist()), kind).reshape(-1, parts))
    vecs = []
    for (_, parts), place in zip(LEVELS, _places(level)):
        out = np.zeros((int(place.max(initial=-1)) + 1, parts), np.uint16)
        for rows, v in own.values():
            if v.shape[1] >= parts:
                out[place[rows]] = v.reshape(len(rows), -1, parts).sum(1)
        vecs.append(out)
    return level, vecs


def _part_groups(percent: int):
    """Edges (a, b) between the holders of a shingle that may link, through the first of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        group, doc, n = (rows.column(i).to_numpy() for i in range(3))
        level, vecs = _columns(rows.column(3).combine_chunks())
        places = _places(level)
        order = np.lexsort((doc, group))
        edge = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1], [True]])) if len(group) else np.zeros(1, np.int64)
        head = np.arange(len(doc))
        for x, y in zip(edge, edge[1:]):
            at = order[x:y]
            head[at] = at[_gathered(vecs, n[at], percent, [place[at] for place in places])]
        yield pa.RecordBatch.from_pydict({"a": pa.array(doc), "b": pa.array(doc[head])})

    return run


def _near_pairs(percent: int):
    """Pairs (a, b) of the rows (a, b, na, nb, open, va, vb) whose counts allow a link, and all that are not open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            na, nb = (rows.column(i).to_numpy() for i in (2, 3))
            (la, va), (lb, vb) = _columns(rows.column(5)), _columns(rows.column(6))
            keep = ~rows.column(4).to_numpy(zero_copy_only=False)
            for k, (x, y) in enumerate(zip(_places(la), _places(lb))):
                at = np.flatnonzero(~keep & (np.minimum(la, lb) == k))
                apart = np.abs(va[k][x[at]].astype(np.int32) - vb[k][y[at]].astype(np.int32)).sum(1)
                keep[at] = apart * (100 + percent) <= (100 - percent) * (na[at] + nb[at])
            yield pa.RecordBatch.from_pydict({c: rows.column(i).filter(pa.array(keep)) for i, c in enumerate("ab")})

    return run


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def join_region(
    sets: list[np.ndarray], percent: int, visitors: np.ndarray | None = None, side: np.ndarray | None = None
) -> np.ndarray:
    """Component (index of its first member) of each sorted hash set; with ``visitors``, only their links are needed, and
    with ``side``, only those to members of another side.

    Recursion by pivots: a pivot's distances to its window are exact; a window holds the members that the triangle
    inequality over all earlier pivots, and the sizes, leave as possible partners of other components.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if m else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    comp = np.arange(m)
    radius = 1 - percent / 100
    level = _level(size)
    places, deep = _places(level), LEVELS[: level.max(initial=0) + 1]
    vecs = [_counts(np.repeat(np.arange(m), size), flat, level >= k, parts).astype(np.uint16) for k, (_, parts) in enumerate(deep)]
    known: list[np.ndarray] = []
    done = np.zeros(m, bool) if visitors is None else ~visitors
    asked = np.zeros(m, bool)
    rounds = 0
    while True:
        left = np.flatnonzero(~done)
        if not len(left):
            return comp
        largest = np.bincount(comp).argmax()
        # The largest component needs no pivot of its own: links to it are found from the other side.
        outside = left[comp[left] != largest] if rounds and visitors is None else left
        if not len(outside):
            return comp
        p = int(outside[0])
        # Links of members that were pivots before are known.
        among = (comp != comp[p]) & ~asked
        if side is not None:
            among &= side != side[p]
        window = _may_link(vecs, size, p, percent, among, places)
        for d in known:
            # An unknown distance is NaN and excludes nothing.
            window &= ~(np.abs(d - d[p]) > radius + 1e-9)
        w = np.flatnonzero(window)
        if len(w):
            lens = size[w]
            total = int(lens.sum())
            at = np.repeat(first[w] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(total)
            mine = sets[p]
            where = np.searchsorted(mine, flat[at])
            hit = mine[np.minimum(where, len(mine) - 1)] == flat[at]
            common = np.bincount(np.repeat(np.arange(len(w)), lens), hit, len(w)).astype(np.int64)
            close = w[linked(common, lens, size[p], percent)]
            if len(known) < 16 and len(w) > 32:
                d = np.full(m, np.nan)
                d[w] = 1 - common / (lens + size[p] - common)
                d[p] = 0.0
                known.append(d)
            _merge(comp, np.append(close, p))
        done[p] = asked[p] = True
        rounds += 1


def _region_task(percent: int, visiting: bool):
    """Groups consecutive rows (key, doc, visitor, side, body) of a sorted partition and joins each group."""

    def flush(docs, visitors, sides, sets):
        ids = np.array(docs, np.int64)
        comp = join_region(sets, percent, *((np.array(visitors, bool), np.array(sides, np.int64)) if visiting else ()))
        return pa.RecordBatch.from_pydict({"a": pa.array(ids), "b": pa.array(ids[comp])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, visitors, sides, sets = None, [], [], [], []
        for b in batches:
            for k, d, v, s, body in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                if k != key and docs:
                    yield flush(docs, visitors, sides, sets)
                    docs, visitors, sides, sets = [], [], [], []
                key = k
                docs.append(d)
                visitors.append(v)
                sides.append(s)
                # A copy: a view would keep the whole batch in memory.
                sets.append(np.frombuffer(body.as_buffer(), np.int64).copy())
        if docs:
            yield flush(docs, visitors, sides, sets)

    return run


def _shipped(docs: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """Sets of the documents of ``labels`` (doc_id and other columns): those columns and body, sorted hashes as bytes."""
    carry = [c for c in labels.columns if c != "doc_id"]
    rows = docs.join(labels, "doc_id").select("doc_id", "text", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words in text_chunks(b.column(1), True):
                own, h, _ = _sets(words, width)
                edge = np.searchsorted(own, np.arange(hi - lo + 1))
                signed = h.view(np.int64)
                body = [np.sort(signed[x:y]).tobytes() for x, y in zip(edge, edge[1:])]
                more = {c: b.column(k + 2)[lo:hi] for k, c in enumerate(carry)}
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)[lo:hi], **more, "body": pa.array(body, pa.binary())})

    return rows.mapInArrow(run, StructType([*rows.drop("text").schema, StructField("body", BinaryType())]))


def _joined(rows: DataFrame, percent: int, visiting: bool) -> DataFrame:
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    side = F.col("side") if visiting else F.lit(0).cast("long")
    spread = rows.select("key", "doc_id", "visitor", side.alias("side"), "body").repartition(int(n), "key").sortWithinPartitions("key", "doc_id")
    return spread.mapInArrow(_region_task(percent, visiting), "a long, b long")


def jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= ``percent`` * union.

    Returns doc_id, n_shingles (long), component_id: the smallest doc_id that links reach, itself included. Letters A-Z
    are folded, words are runs of ``[^\\x20\\x09-\\x0D]``; a text with fewer words than ``width`` has one shingle, its whole
    sequence; a text without words (or a null) has none and links with nothing, not even with its like. Rows with a null
    doc_id take no part in links and have a null component. Rows that share an id share a component. Repeated rows stay.
    An empty table gives an empty result. Only doc_id and text are read. Every link between different texts counts;
    ``block`` bounds the documents that one task joins, not what is joined.
    """
    with Scratch(docs.sparkSession) as scratch:
        return released(_join(docs.select("doc_id", "text"), width, percent, block, scratch))


def _join(docs: DataFrame, width: int, percent: int, block: int, scratch: Scratch) -> DataFrame:
    nameless = docs.filter("doc_id is null")
    docs = docs.filter("doc_id is not null")
    scan = scratch.store(describe(docs, width))
    slim = scan.filter("n >= 0")
    often = scan.filter("n < 0").groupBy("a").count().orderBy(F.desc("count"), "a").limit(FREQUENT).select("a").collect()
    frequent = np.array(sorted(r["a"] for r in often), np.int64).view(np.uint64)
    frequent.sort()
    # No document has more first shingles than this, so their number need not be counted by a pass of its own.
    total = slim.agg(F.sum(F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // 1_000_000))
    keyed = slim.filter("n > 0").withColumn("set", F.concat_ws(":", "n", "a", "b"))
    classes = scratch.store(keyed.groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # The sets with most copies meet their documents by broadcast, a fixed number of them; no other can be hot.
    joined = lookup_join(keyed, classes, "set", "copies", how="inner", row_id="doc_id")
    member = scratch.store(joined.select("doc_id", "rep", "n", "vec"))
    sized = scratch.store(slim.select("doc_id", F.col("n").alias("n_shingles")))
    scratch.drop(scan, classes)

    first = _first_shingles(docs, width, percent, frequent)
    met = scratch.store(first.repartition(parts, "hash").mapInArrow(_meet, "x long, y long, open boolean, group long"))
    pairs = met.filter("group is null").groupBy("x", "y").agg(F.min("open").alias("open"))
    holders = met.filter("group is not null").select("group", F.col("x").alias("doc_id"))
    holders = holders.join(member, "doc_id").select("group", "rep", "n", "vec").repartition(parts, "group")
    gathered = scratch.store(holders.mapInArrow(_part_groups(percent), "a long, b long").filter("a <> b").distinct())
    left = member.select(F.col("doc_id").alias("x"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = member.select(F.col("doc_id").alias("y"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
    both = pairs.join(left, "x").join(right, "y").filter("a <> b")
    fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = both.filter(~F.col("open") | fit).select("a", "b", "na", "nb", "open", "va", "vb")
    near = scratch.store(both.mapInArrow(_near_pairs(percent), "a long, b long").distinct())
    scratch.drop(met)
    regions = connected_components(near.union(gathered), scratch)
    weights = regions.join(member.filter("doc_id = rep").select(F.col("rep").alias("node"), "n").distinct(), "node")
    whole = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES))
    sizes = weights.groupBy("component").agg(whole.alias("blocks"))
    labels = regions.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("region"), "blocks")
    labels = scratch.store(labels)
    copies = scratch.store(member.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    scratch.drop(near, gathered, member)
    # Sets go straight to the task of their block. They are larger than the texts, so they are made anew where blocks of one
    # region meet, and never stored.
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    cut = _shipped(docs, labels, width).withColumns({"key": F.to_json(F.struct("region", mine.alias("block"))), "visitor": F.lit(False)})
    links = scratch.store(_joined(cut, percent, False).filter("a <> b"))
    if labels.filter("blocks > 1").take(1):
        links = scratch.store(_across(labels, links, percent, scratch, lambda rows: _shipped(docs, rows, width)))
    # Copies of a text are linked to their class already.
    found = connected_components(links.select("a", "b").union(copies), scratch)
    out = sized.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    blank = describe(nameless.select(F.lit(0).cast("long").alias("doc_id"), "text"), width).filter("n >= 0")
    return out.union(blank.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long")))


def _across(sets: DataFrame, links: DataFrame, percent: int, scratch: Scratch | None = None, ship=None) -> DataFrame:
    """Links between the blocks of regions that have several; the links given are part of the result.

    First one member of each component of a block meets those of the other blocks, as many as one block holds at a time.
    What then lies outside the largest component of its region visits the other blocks (`_visits`): no task holds more
    than two blocks, however many visitors there are. ``sets`` has doc_id, region, blocks; ``ship`` adds the body to such
    rows, by default from ``sets``.
    """
    wide = sets.filter("blocks > 1").select("doc_id", "region", "blocks")
    scratch = scratch or Scratch(sets.sparkSession)
    ship = ship or (lambda rows: rows.join(sets.select("doc_id", "region", "body"), ["doc_id", "region"]))

    def labelled(more: DataFrame) -> DataFrame:
        comp = connected_components(more.select("a", "b"), scratch)
        named = wide.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return scratch.store(named.withColumn("component", F.coalesce("component", "doc_id")))

    now = labelled(links)
    first = F.col("doc_id") == F.col("component")
    share = now.groupBy("region").agg(F.ceil(F.max("blocks") * F.count_if(first) / F.count("*")).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit("head"), "doc_id"), "parts")
    heads = ship(now.filter(first).join(share.filter("parts > 0"), "region").select("doc_id", "region", part.alias("part")))
    heads = heads.withColumns({"key": F.to_json(F.struct("region", F.col("part").alias("head"))), "visitor": F.lit(False)})
    links = scratch.store(links.union(_joined(heads, percent, False).filter("a <> b")))
    scratch.drop(now)
    now = labelled(links)
    counts = now.groupBy("region", "component").count()
    largest = counts.groupBy("region").agg(
        F.max_by("component", F.struct("count", -F.col("component"))).alias("largest"),
        F.sum("count").alias("docs"),
        (F.sum("count") - F.max("count")).alias("visitors"),
    )
    now = now.join(largest.filter("visitors > 0"), "region").withColumn("visitor", F.col("component") != F.col("largest"))
    now = ship(scratch.store(now.select("doc_id", "region", "blocks", "visitor", "docs", "visitors")))
    return links.union(_joined(_visits(now), percent, True).filter("a <> b"))


def _visits(rows: DataFrame) -> DataFrame:
    """Each document under the keys where it meets members of other blocks: key, visitor and side are added.

    Where most are visitors, each pair of blocks meets under one key, its two sides. Otherwise visitors are cut into
    parts of the size of a block and each part meets each block; the blocks are one side, the visitors the other.
    """
    home = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    away = F.filter(blocks, lambda j: j != home)
    parts = F.ceil(F.col("blocks") * F.col("visitors") / F.col("docs"))
    part = F.pmod(F.xxhash64(F.lit("visit"), "doc_id"), parts)
    none = F.lit(-1).cast("long")

    def at(i, j, visitor, side):
        return F.struct(i.alias("i"), j.alias("j"), visitor.alias("visitor"), side.alias("side"))

    paired = F.transform(away, lambda j: at(F.least(home, j), F.greatest(home, j), F.col("visitor"), home))
    abroad = F.transform(away, lambda j: at(part, j, F.lit(True), none))
    here = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: at(i, home, F.lit(False), home))
    cut = F.when(F.col("visitor"), F.concat(abroad, here)).otherwise(here)
    places = F.when(2 * F.col("visitors") > F.col("docs"), paired).otherwise(cut)
    rows = rows.select("doc_id", "region", "body", F.explode(places).alias("at"))
    return rows.select("doc_id", "body", F.to_json(F.struct("region", "at.i", "at.j")).alias("key"), "at.visitor", "at.side")
