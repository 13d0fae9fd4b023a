"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convsignals.llm.tables import Scratch

#: Edges that a task contracts together before the rounds.
CHUNK = 500_000


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its part) of what the edges join, without the smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new != (jump := new[new])).any():
            new = jump
        if (new == label).all():
            rest = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[rest], nodes[label[rest]]
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every CHUNK edges (u, v) as stars with the same parts: at most one edge a node."""
    held, rows = [], 0

    def flush():
        u, v = _stars(*(np.concatenate(c) for c in zip(*held)))
        return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        rows += b.num_rows
        if rows >= CHUNK:
            yield flush()
            held, rows = [], 0
    if held:
        yield flush()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of the edges (a, b), both long: the smallest node that is reachable.

    Loops and repeated edges do no harm; rows with a null end are no edges; no edges give an empty result. Only the
    smallest neighbour of a node is aggregated, never its list of neighbours, and each round is a written table that
    replaces the one before; the last one belongs to ``scratch``, if given.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = edges.filter("a is not null and b is not null and a <> b")
    e = scratch.store(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(e)
    if mark[0]:
        # Edges are many where a group is large; stars have no more edges than nodes, and the rounds start from them.
        many = e
        e = scratch.store(many.coalesce(-(-mark[0] // CHUNK)).mapInArrow(_contracted, "u long, v long").distinct())
        scratch.drop(many)
        mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        before = e
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        star = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.store(star.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        scratch.drop(before)
        new = _mark(e)
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
