"""Exact percentiles of long ``(group, value)`` tables by distributed selection: no group is ordered in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of one round; a band keeps about this part of its rows.
BINS = 64
ACCURACY = 10_000
#: A band of so few rows is counted value by value.
SMALL_BAND = 2_000


@dataclass
class _Target:
    """The value at position ``index`` of a group's sorted values lies in [low, high]; ``below`` values are less than low."""

    number: int
    group: Any
    index: int
    low: Any
    high: Any
    below: int
    inside: int

    @property
    def found(self) -> bool:
        return self.low == self.high


def _banded(values: DataFrame, targets: list[_Target], extra: dict[int, Any] | None = None) -> DataFrame:
    """Rows (target, value) of each target's band. Targets are a fixed few, so they are broadcast."""
    group, value = values.schema["group"], values.schema["value"]
    schema = T.StructType(
        [
            T.StructField("target", T.IntegerType()),
            T.StructField("group", group.dataType),
            T.StructField("low", value.dataType),
            T.StructField("high", value.dataType),
            T.StructField("edges", T.ArrayType(value.dataType)),
        ]
    )
    rows = [(t.number, t.group, t.low, t.high, (extra or {}).get(t.number)) for t in targets]
    bands = F.broadcast(values.sparkSession.createDataFrame(rows, schema))
    inside = values.alias("v").join(bands.alias("b"), F.col("v.group").eqNullSafe(F.col("b.group")))
    return inside.where("v.value >= b.low AND v.value <= b.high").select("target", "value", "edges")


def _narrow(values: DataFrame, targets: list[_Target]) -> None:
    """Cut each band at approximate quantiles of its rows and keep the bin that holds the position."""
    points = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cut = _banded(values, targets).groupBy("target").agg(F.percentile_approx("value", points, F.lit(ACCURACY)).alias("edges"))
    edges = {r["target"]: sorted(set(r["edges"])) for r in cut.collect()}
    # A value that fills many quantiles becomes a bin of its own: an edge counts as twice the number of edges up to it.
    place = F.size(F.filter("edges", lambda e: e < F.col("value"))) + F.size(F.filter("edges", lambda e: e <= F.col("value")))
    bins = (
        _banded(values, targets, edges)
        .groupBy("target", place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    found: dict[int, list] = {}
    for r in bins.collect():
        found.setdefault(r["target"], []).append(r)
    for t in targets:
        for r in sorted(found[t.number], key=lambda r: r["bin"]):
            if t.index < t.below + r["n"]:
                t.low, t.high, t.inside = r["low"], r["high"], r["n"]
                break
            t.below += r["n"]


def _count(values: DataFrame, targets: list[_Target]) -> None:
    """Find the position in small bands from the counts of their distinct values."""
    counts: dict[int, list] = {}
    for r in _banded(values, targets).groupBy("target", "value").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["target"], []).append((r["value"], r["n"]))
    for t in targets:
        for value, n in sorted(counts[t.number]):
            if t.index < t.below + n:
                t.low = t.high = value
                break
            t.below += n


def exact_percentiles(
    values: DataFrame,
    group: str,
    value: str,
    fractions: Sequence[float],
    method: str = "linear",
) -> DataFrame:
    """Rows ``(group, fraction, percentile)``; groups are few (a list of features or measures).

    Each sought position is bracketed by a band of values. In rounds, the rows of a band are counted in bins whose edges
    are approximate quantiles of the band, so whatever the distribution the bin that holds the position has about 1/BINS of
    the rows; a band that holds one value, or few rows, ends the search. Counts of bins reach the driver, never rows. Nulls are
    left out and a group without values has no row. ``linear`` interpolates at (n-1)*p; ``nearest`` takes the value at
    index min(floor(n*p), n-1) of the sorted rows.
    """
    spark = values.sparkSession
    rows = values.select(F.col(group).alias("group"), F.col(value).alias("value")).where("value IS NOT NULL")
    ends = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    targets: list[_Target] = []
    wanted = []
    for e in ends:
        for p in fractions:
            if method == "linear":
                place = (e["n"] - 1) * p
                first, second, weight = math.floor(place), math.ceil(place), place - math.floor(place)
            else:
                first = second = min(math.floor(e["n"] * p + 1e-9), e["n"] - 1)
                weight = 0.0
            pair = []
            for index in (first, second):
                known = next((t for t in targets if t.group == e["group"] and t.index == index), None)
                if known is None:
                    known = _Target(len(targets), e["group"], index, e["low"], e["high"], 0, e["n"])
                    targets.append(known)
                pair.append(known)
            wanted.append((e["group"], float(p), *pair, weight))
    while open_ := [t for t in targets if not t.found]:
        wide = [t for t in open_ if t.inside > SMALL_BAND]
        if wide:
            _narrow(rows, wide)
        else:
            _count(rows, open_)
    out = [(g, p, float(a.low) + (float(b.low) - float(a.low)) * w) for g, p, a, b, w in wanted]
    schema = T.StructType(
        [
            T.StructField(group, values.schema[group].dataType),
            T.StructField("fraction", T.DoubleType()),
            T.StructField("percentile", T.DoubleType()),
        ]
    )
    return spark.createDataFrame(out, schema)
