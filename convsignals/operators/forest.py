"""A random forest for many rows: large nodes are split from summed histograms, small nodes are finished where their rows meet.

Spark ML sends a dense histogram of every open node from every partition, also of nodes with a few rows, so deep trees cost nodes times
partitions. Here a node has histograms only while it holds more than ``local_rows`` rows; then its rows are shuffled to one task that
grows the rest of it. Subtrees stay in a table and are joined with the rows they judge, so neither rows nor trees pass the driver.

Bags and feature choices are hashes of (row key, tree) and (tree, node): the forest depends neither on partitions nor on ``local_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convsignals.session import dealt_tasks, stored

#: A node of at most so many rows is finished by one task.
LOCAL_ROWS = 50_000
#: Histograms of one pass over the rows, and their cells at once in a task.
PASS_NODES = 8192
CELLS = 1 << 22
#: Rows that one task judges with one subtree.
JUDGED_ROWS = 1_000_000
#: Votes are whole parts of this, so that the order of their sum does not show.
VOTE = 1 << 40
GOLDEN = 0x9E3779B97F4A7C15
#: Chances of at most 0, 1, 2, ... copies of a row in a bag: Poisson with mean 1.
BAG = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 20)]))


def _mix(x: np.ndarray) -> np.ndarray:
    """The last step of splitmix64: well-spread 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Shape:
    """What a task must know to grow a tree. ``column`` has the place of each feature in the binned rows; constant ones share a last column of zeros."""

    column: np.ndarray
    subset: int
    bins: int
    classes: int
    min_leaf: int
    max_depth: int
    seed: int

    @property
    def width(self) -> int:
        return int(self.column.max()) + 1

    def salt(self, tree: int, use: int) -> np.uint64:
        return _mix(np.array([((self.seed * 1_000_003 + int(tree)) * 2 + use + 1) * GOLDEN % 2**64], np.uint64))[0]

    def copies(self, ids: np.ndarray, tree: int) -> np.ndarray:
        """How often the bag of the tree holds each row."""
        u = (_mix(ids.view(np.uint64) + self.salt(tree, 0)) >> np.uint64(11)) * 2.0**-53
        return np.searchsorted(BAG, u, side="right").astype(np.uint8)

    def chosen(self, paths: np.ndarray, tree: int) -> np.ndarray:
        """The features that each node may split on, ascending."""
        places = np.arange(len(self.column), dtype=np.uint64) * np.uint64(GOLDEN)
        h = _mix(_mix(paths.astype(np.uint64) + self.salt(tree, 1))[:, None] + places)
        return np.sort(np.argpartition(h, self.subset - 1, axis=1)[:, : self.subset], axis=1)

    def histograms(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Bag copies by [node, chosen feature, bin, class]."""
        k, s = chosen.shape
        bins = x[np.arange(len(x))[:, None], self.column[chosen][node]]
        cell = ((node[:, None] * s + np.arange(s)) * self.bins + bins) * self.classes + y[:, None]
        return np.bincount(cell.ravel(), np.repeat(w, s), k * s * self.bins * self.classes).reshape(k, s, self.bins, self.classes)

    def best(self, hist: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature (-1: none), last bin on the left, Gini gain times rows, and copies by class on the left, of each node."""
        left = hist.cumsum(axis=2)
        total = left[:, :1, -1:]
        right = total - left
        nl, nr = left.sum(-1), right.sum(-1)
        gain = (left**2).sum(-1) / np.maximum(nl, 1) + (right**2).sum(-1) / np.maximum(nr, 1)
        gain -= (total**2).sum(-1) / np.maximum(total.sum(-1), 1)
        gain[(nl < self.min_leaf) | (nr < self.min_leaf)] = -1
        at = gain.reshape(len(gain), -1).argmax(1)
        slot, cut, k = at // self.bins, at % self.bins, np.arange(len(at))
        won = gain[k, slot, cut]
        return np.where(won > 1e-9, chosen[k, slot], -1), cut, won, left[k, slot, cut]

    def may_split(self, totals: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """Nodes of several classes, enough rows and a depth below the limit; a path is the node's number in a full binary tree."""
        n = totals.sum(1)
        return (totals.max(1) < n) & (n >= 2 * self.min_leaf) & (paths < 1 << self.max_depth)


@dataclass
class Tree:
    """Nodes in arrays: feature (-1: leaf), last bin on the left, left child (the right one follows), bag copies by class."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    counts: np.ndarray

    def walk(self, x: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at, live = np.zeros(len(x), np.int64), np.arange(len(x))
        while live.size:
            inner = self.feature[at[live]] >= 0
            live = live[inner]
            here = at[live]
            at[live] = self.child[here] + (x[live, column[self.feature[here]]] > self.cut[here])
        return at

    def votes(self) -> np.ndarray:
        """Class shares of each node in parts of VOTE; the last class takes the rest."""
        share = np.floor(self.counts / np.maximum(self.counts.sum(1, keepdims=True), 1) * VOTE).astype(np.int64)
        share[:, -1] = VOTE - share[:, :-1].sum(1)
        return share


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, path: int, tree: int, shape: Shape) -> tuple[Tree, np.ndarray]:
    """The subtree below a node from all of its rows, level by level, and the gain of each feature."""
    gains, levels, first = np.zeros(len(shape.column)), [], 0
    paths, rows, node = np.array([path]), np.arange(len(x)), np.zeros(len(x), np.int64)
    step = max(1, CELLS // (shape.subset * shape.bins * shape.classes))
    while len(paths):
        k, c = len(paths), shape.classes
        totals = np.bincount(node * c + y[rows], w[rows], k * c).reshape(k, c)
        open_ = shape.may_split(totals, paths)
        ids, keep = np.flatnonzero(open_), open_[node]
        rows, node = rows[keep], (np.cumsum(open_) - 1)[node[keep]]
        feature, cut = np.full(k, -1, np.int16), np.zeros(k, np.uint8)
        for lo in range(0, len(ids), step):
            part = ids[lo : lo + step]
            a, z = np.searchsorted(node, [lo, lo + step])
            r, chosen = rows[a:z], shape.chosen(paths[part], tree)
            f, b, gain, _ = shape.best(shape.histograms(x[r], y[r], w[r], node[a:z] - lo, chosen), chosen)
            feature[part], cut[part] = f, b
            gains += np.bincount(f[f >= 0], gain[f >= 0], len(gains))
        inner = feature >= 0
        rank, at = np.cumsum(inner) - 1, ids[node]
        child = np.where(inner, first + k + 2 * rank, 0).astype(np.int32)
        levels.append((feature, cut, child, totals.astype(np.int32)))
        rows, at = rows[inner[at]], at[inner[at]]
        node = 2 * rank[at] + (x[rows, shape.column[feature[at]]] > cut[at])
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        first, paths = first + k, (2 * paths[inner][:, None] + np.arange(2)).ravel()
    return Tree(*map(np.concatenate, zip(*levels))), gains


@dataclass
class Top:
    """The start of one tree on the driver: nodes split from histograms, and which leaves tasks finish."""

    tree: Tree
    path: np.ndarray
    size: np.ndarray
    open: np.ndarray
    gains: np.ndarray

    def split(self, at: int, feature: int, cut: int, gain: float, left: np.ndarray, right: np.ndarray, shape: Shape) -> None:
        t, both = self.tree, np.stack([left, right])
        self.open[at] = False
        t.counts[at] = left + right
        if feature < 0:
            return
        paths = 2 * self.path[at] + np.arange(2)
        t.feature[at], t.cut[at], t.child[at] = feature, cut, len(t.feature)
        self.gains[feature] += gain
        self.tree = Tree(np.append(t.feature, [-1, -1]), np.append(t.cut, [0, 0]), np.append(t.child, [0, 0]), np.concatenate([t.counts, both]))
        self.path, self.size = np.append(self.path, paths), np.append(self.size, both.sum(1))
        self.open = np.append(self.open, shape.may_split(both, paths))


def _edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Thresholds per feature: between all values where at most ``bins`` occur, else at quantiles; none for a constant."""
    a = rows.select(vector_to_array("features").alias("a"))
    places = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    facts = a.agg(
        *[F.approx_count_distinct(F.col("a")[i]).alias(f"n{i}") for i in range(width)],
        *[F.percentile_approx(F.col("a")[i], places, F.lit(10_000)).alias(f"q{i}") for i in range(width)],
    ).first()
    few = [i for i in range(width) if facts[f"n{i}"] <= 2 * bins]
    sets = a.agg(F.lit(0), *[F.collect_set(F.col("a")[i]).alias(f"s{i}") for i in few]).first()
    out = []
    for i in range(width):
        values = np.unique(sets[f"s{i}"]) if i in few else None
        if values is not None and len(values) <= bins:
            out.append((values[:-1] + values[1:]) / 2)
        else:
            out.append(np.unique(facts[f"q{i}"]))
    return out


def _blocks(rows: DataFrame, n: int, edges: list[np.ndarray], shape: Shape) -> DataFrame:
    """Binned rows ``(ids, x, y)`` packed by batch, for the ``id`` and ``label_id`` of the given rows."""
    used = [i for i, e in enumerate(edges) if len(e)]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.stack(batch["a"].to_numpy())
            x = np.zeros((len(batch), shape.width), np.uint8)
            for i in used:
                x[:, shape.column[i]] = np.searchsorted(edges[i], values[:, i], side="left")
            ids, y = batch["id"].to_numpy(np.int64), batch["y"].to_numpy(np.uint8)
            yield pd.DataFrame({"ids": [ids.tobytes()], "x": [x.tobytes()], "y": [y.tobytes()]})

    tasks = max(1, min(dealt_tasks(rows.sparkSession), n // 1024))
    packed = rows.select("id", vector_to_array("features").alias("a"), F.col("label_id").cast("int").alias("y")).repartition(tasks)
    return stored(packed.mapInPandas(pack, "ids binary, x binary, y binary"))


def _unpacked(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, x, y in zip(batch["ids"], batch["x"], batch["y"]):
            yield np.frombuffer(ids, np.int64), np.frombuffer(x, np.uint8).reshape(-1, width), np.frombuffer(y, np.uint8)


def _best_splits(blocks: DataFrame, state: dict[int, tuple[Tree, np.ndarray, np.ndarray]], shape: Shape) -> DataFrame:
    """The best split of each given (tree, node) from histograms that Spark sums; ``state`` has tree, nodes and paths by tree."""
    size = (shape.subset, shape.bins, shape.classes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {t: np.zeros((len(nodes), *size)) for t, (_, nodes, _) in state.items()}
        for ids, x, y in _unpacked(batches, shape.width):
            for t, (tree, nodes, paths) in state.items():
                w, here = shape.copies(ids, t), tree.walk(x, shape.column)
                place = np.searchsorted(nodes, here).clip(max=len(nodes) - 1)
                r = np.flatnonzero((w > 0) & (nodes[place] == here))
                sums[t] += shape.histograms(x[r], y[r], w[r], place[r], shape.chosen(paths, t))
        for t, (_, nodes, _) in state.items():
            yield pd.DataFrame({"tree": t, "node": nodes, "hist": [h.tobytes() for h in sums[t]]})

    def choose(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        t, k = key
        _, nodes, paths = state[t]
        hist = sum(np.frombuffer(h).reshape(1, *size) for h in pieces["hist"])
        feature, cut, gain, left = shape.best(hist, shape.chosen(paths[nodes == k], t))
        right = hist[0, 0].sum(0) - left[0]
        return pd.DataFrame({"tree": [t], "node": [k], "feature": feature, "cut": cut, "gain": gain, "l": [left[0].tolist()], "r": [right.tolist()]})

    counted = blocks.mapInPandas(count, "tree int, node int, hist binary").groupBy("tree", "node")
    return counted.applyInPandas(choose, "tree int, node int, feature int, cut int, gain double, l array<double>, r array<double>")


def _split_large(blocks: DataFrame, tops: list[Top], local_rows: int, shape: Shape) -> None:
    """Split all nodes beyond ``local_rows``; a pass over the rows serves up to PASS_NODES of them."""
    while large := [(t, k) for t, top in enumerate(tops) for k in np.flatnonzero(top.open & (top.size > local_rows)).tolist()]:
        at: dict[int, list[int]] = {}
        for t, k in large[:PASS_NODES]:
            at.setdefault(t, []).append(k)
        state = {t: (tops[t].tree, np.array(nodes), tops[t].path[nodes]) for t, nodes in at.items()}
        for s in _best_splits(blocks, state, shape).collect():
            tops[s["tree"]].split(s["node"], s["feature"], s["cut"], s["gain"], np.array(s["l"]), np.array(s["r"]), shape)


def _subtree_row(tree: int, path: int, made: Tree, gains: np.ndarray) -> tuple:
    arrays = (made.feature.astype(np.int16), made.cut.astype(np.uint8), made.child.astype(np.int32), made.counts.astype(np.int32), gains)
    return (tree, path, *[bytearray(a.tobytes()) for a in arrays])


SUBTREE = "tree int, node long, feature binary, cut binary, child binary, counts binary, gains binary"


def _grow_small(blocks: DataFrame, tops: list[Top], shape: Shape) -> DataFrame:
    """Subtrees of all leaves of the tops, each grown in the task where its rows meet; settled leaves are trees of one node."""
    state = [(top.tree, top.path, top.open) for top in tops]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x, y in _unpacked(batches, shape.width):
            out = []
            for t, (tree, path, open_) in enumerate(state):
                w, at = shape.copies(ids, t), tree.walk(x, shape.column)
                for k in np.flatnonzero(open_):
                    r = np.flatnonzero((w > 0) & (at == k))
                    if r.size:
                        out.append((t, path[k], x[r].tobytes(), y[r].tobytes(), w[r].tobytes()))
            yield pd.DataFrame(out, columns=["tree", "node", "x", "y", "w"])

    def finish(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (np.frombuffer(b"".join(pieces[c]), np.uint8) for c in ("x", "y", "w"))
        made, gains = grow(x.reshape(-1, shape.width), y, w, key[1], key[0], shape)
        return pd.DataFrame([_subtree_row(*key, made, gains)], columns=[c.split()[0] for c in SUBTREE.split(", ")])

    spark = blocks.sparkSession
    sent = blocks.mapInPandas(send, "tree int, node long, x binary, y binary, w binary")
    grown = sent.repartition(dealt_tasks(spark), "tree", "node").groupBy("tree", "node").applyInPandas(finish, SUBTREE)
    none = np.zeros(len(shape.column))
    settled = [
        _subtree_row(t, int(top.path[k]), Tree(np.array([-1]), np.zeros(1), np.zeros(1), top.tree.counts[k : k + 1]), none)
        for t, top in enumerate(tops)
        for k in np.flatnonzero((top.tree.feature < 0) & ~top.open)
    ]
    return stored(grown.unionByName(spark.createDataFrame(settled, SUBTREE)) if settled else grown)


@dataclass
class ForestModel:
    """Thresholds and tops on the driver, subtrees in a table."""

    edges: list[np.ndarray]
    shape: Shape
    tops: list[Top]
    subtrees: DataFrame

    @property
    def featureImportances(self) -> DenseVector:
        """Gain of each feature, as shares within a tree, averaged over the trees."""
        gains = np.stack([top.gains for top in self.tops])
        for r in self.subtrees.select("tree", "gains").toLocalIterator():
            gains[r["tree"]] += np.frombuffer(r["gains"])
        shares = (gains / np.maximum(gains.sum(1, keepdims=True), 1e-300)).sum(0)
        return DenseVector(shares / max(shares.sum(), 1e-300))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``probability``, the mean of the class shares in the rows' leaves, and ``prediction``."""
        rows = stored(rows.withColumn("id", F.monotonically_increasing_id()))
        n, shape, state = rows.count(), self.shape, [(top.tree, top.path) for top in self.tops]
        parts, names = 1 + n // JUDGED_ROWS, [f"v{i}" for i in range(self.shape.classes)]

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids, x, _ in _unpacked(batches, shape.width):
                out, part = [], int(_mix(ids[:1].view(np.uint64))[0] % np.uint64(parts))
                for t, (tree, path) in enumerate(state):
                    at = tree.walk(x, shape.column)
                    for k in np.unique(at):
                        r = np.flatnonzero(at == k)
                        out.append((t, path[k], part, ids[r].tobytes(), x[r].tobytes()))
                yield pd.DataFrame(out, columns=["tree", "node", "part", "ids", "x"])

        def vote(pieces: pd.DataFrame, subtrees: pd.DataFrame) -> pd.DataFrame:
            if pieces.empty or subtrees.empty:
                return pd.DataFrame({c: np.zeros(0, np.int64) for c in ["id", *names]})
            s = subtrees.iloc[0]
            arrays = [np.frombuffer(s[c], kind) for c, kind in (("feature", np.int16), ("cut", np.uint8), ("child", np.int32), ("counts", np.int32))]
            made = Tree(*arrays[:3], arrays[3].reshape(-1, shape.classes))
            x = np.frombuffer(b"".join(pieces["x"]), np.uint8).reshape(-1, shape.width)
            votes = made.votes()[made.walk(x, shape.column)]
            return pd.DataFrame({"id": np.frombuffer(b"".join(pieces["ids"]), np.int64)} | dict(zip(names, votes.T)))

        given = rows.withColumn("label_id", F.lit(0)) if "label_id" not in rows.columns else rows
        blocks = _blocks(given.fillna(0, subset=["label_id"]), n, self.edges, shape)
        sent = blocks.mapInPandas(send, "tree int, node long, part int, ids binary, x binary")
        copies = self.subtrees.drop("gains").withColumn("part", F.explode(F.array(*[F.lit(p) for p in range(parts)])))
        keys = ["tree", "node", "part"]
        votes = sent.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(vote, ", ".join(f"{c} long" for c in ["id", *names]))
        sums = votes.groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
        p = F.array(*[F.col(c).cast("double") for c in names])
        total = sum((F.col(c) for c in names), F.lit(0)).cast("double")
        sums = sums.select("id", F.transform(p, lambda v: v / total).alias("_p"))
        judged = rows.join(sums, "id", "left").withColumn("_p", F.coalesce("_p", F.array(*[F.lit(1.0 / len(names))] * len(names))))
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return judged.withColumns({"probability": array_to_vector("_p"), "prediction": best}).drop("id", "_p")


@dataclass(frozen=True)
class RandomForest:
    """Gini trees on Poisson bags with sqrt(width) features per node and at most 32 bins, as Spark ML grows them.

    Rows have ``key``, a ``features`` vector and ``label_id`` from 0 to classes - 1.
    """

    trees: int = 200
    min_leaf: int = 2
    max_depth: int = 30
    classes: int = 2
    bins: int = 32
    seed: int = 42
    key: str = "conversation_id"
    local_rows: int = field(default=LOCAL_ROWS)

    def fit(self, rows: DataFrame) -> ForestModel:
        known = F.col("label_id").isin(*[float(i) for i in range(self.classes)])
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("known"), F.first("features").alias("one")).first()
        n = facts["n"]
        if not n or facts["known"] < n:
            raise ValueError(f"a forest needs rows, and a class for each: {n} rows, {facts['known']} with a class")
        width = len(facts["one"])
        edges = _edges(rows, width, self.bins)
        varies = np.array([len(e) > 0 for e in edges])
        column = np.where(varies, np.cumsum(varies) - 1, varies.sum())
        shape = Shape(column, min(width, int(np.ceil(np.sqrt(width)))), self.bins, self.classes, self.min_leaf, self.max_depth, self.seed)
        blocks = _blocks(rows.withColumn("id", F.xxhash64(self.key)), n, edges, shape)
        tops = [
            Top(
                Tree(np.array([-1]), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, self.classes))),
                np.array([1]),
                np.array([float(n)]),
                np.array([True]),
                np.zeros(width),
            )
            for _ in range(self.trees)
        ]
        _split_large(blocks, tops, self.local_rows, shape)
        return ForestModel(edges, shape, tops, _grow_small(blocks, tops, shape))
