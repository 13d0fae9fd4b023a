"""Histogram gradient-boosted trees over document statistics.

Features are cut into at most 32 bins, each tree is grown level by level from gradient histograms, and the forest is
flattened into arrays (feature, threshold, value per node of a full binary tree) that numpy walks for all rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from convsignals.llm.quality_rules import fold
from convsignals.llm.statistics import BASE, SHARES, text_statistics
from convsignals.session import stored

#: Bound on the labelled rows that a fit reads: whole hash buckets of ids, in their order.
SAMPLE_ROWS = 50_000
BUCKETS = 4096
CUT = 0.3


@dataclass(frozen=True)
class Forest:
    """Full trees of one depth in arrays [tree, node]; node k has children 2k + 1 (not above) and 2k + 2 (above)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[1]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        rows = np.arange(len(x))
        raw = np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            raw += value[at - len(feature)]
        return 1 / (1 + np.exp(-raw))


def fit_forest(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 3.0
) -> Forest:
    """Boosted trees for labels 0 and 1 (logistic loss). No rows or one class give a constant forest of the smoothed mean."""
    n, m = x.shape if x.ndim == 2 else (0, 1)
    mean = (y.sum() + 1) / (n + 2)
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    grid = np.arange(1, bins) / bins
    cuts = []
    for k in range(m):
        some = x[x[:, k] > 0, k]
        cuts.append(np.unique(np.concatenate([np.quantile(x[:, k], grid), np.quantile(some, grid) if len(some) else []])))
    width = max(map(len, cuts)) + 1
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    keys = binned + np.arange(m) * width
    raw = np.full(n, base)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            flat = ((at - first)[:, None] * (m * width) + keys).ravel()
            gs, hs = (
                np.bincount(flat, np.repeat(v, m), nodes * m * width).reshape(nodes, m, width) for v in (g, h)
            )
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            for k in range(nodes):
                f, b = np.unravel_index(int(gain[k].argmax()), (m, width))
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        raw += value[leaf]
        out.append((feature, threshold, value))
    return Forest(*(np.stack([t[i] for t in out]) for i in range(3)), base)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= cut), n_words.

    The trees see statistics of the text only, never labels, lang, source or the id. They learn from at most
    ``sample_rows`` labelled rows whose crc32 of the id is not 0 modulo 5 (``held_out`` is true for the others, and for
    null ids). Null and empty texts have zero statistics and are scored like any other; null labels are not learned
    from; repeated rows stay; an empty table gives an empty result, and without usable labels every score is the
    smoothed mean of the labels there are (0.5 for none).
    """
    stats = stored(text_statistics(docs))
    rows = stats.join(F.broadcast(labelled_sample(stats, labels, sample_rows)), "doc_id")
    return score_statistics(stats, fit_statistics(rows), cut)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, quality) of the labelled rows to learn from; with all their documents they are at most ``sample_rows`` rows.

    Ids fall into BUCKETS by a hash. Buckets are taken in order, and one that would exceed the bound (an id that very
    many rows share) is passed over. Only the sizes of the buckets and the sample itself reach the driver.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality").distinct()
    marks = marks.filter(fold(F.col("doc_id"), 5) > 0)
    copies = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("copies"))
    found = stored(marks.join(copies, "doc_id").withColumn("bucket", bucket))
    sizes = found.groupBy("bucket").agg(F.sum("copies").alias("n")).orderBy("bucket").collect()
    taken, total = [], 0
    for r in sizes:
        if total + r["n"] <= sample_rows:
            taken.append(r["bucket"])
            total += r["n"]
    return found.filter(F.col("bucket").isin(taken)).select("doc_id", "quality")


def fit_statistics(rows: DataFrame) -> Forest:
    """Trees from the labelled rows (SHARES and ``quality``), whatever their order."""
    sample = rows.select(*SHARES, "quality").toPandas().sort_values([*SHARES, "quality"])
    return fit_forest(sample[SHARES].to_numpy(float).reshape(-1, len(SHARES)), sample["quality"].to_numpy(float))


def score_statistics(stats: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": b["n_words"], "score": forest.scores(b[SHARES].to_numpy(float))})

    scored = stats.select("doc_id", BASE[0], *SHARES).mapInPandas(score, "doc_id long, n_words long, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
        "n_words",
    )


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores ``cut`` or more; each row is judged by itself."""
    sample = labelled_sample(docs, labels, sample_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    forest = fit_statistics(text_statistics(known, carry="quality"))

    # A pass of its own: as a filter it would be unfolded into the statistics.
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in SHARES], 1)
            yield b.select(["row"]).filter(pa.array(forest.scores(x) >= cut))

    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    scored = text_statistics(rows, carry="row").select("row", *SHARES)
    return scored.mapInArrow(keep, StructType([StructField("row", docs.schema)])).select("row.*")
