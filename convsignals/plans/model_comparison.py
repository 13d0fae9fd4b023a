"""Paired comparison of two models: verification, bootstrap, exact test, error analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from convsignals.operators import paired as pr
from convsignals.schema import POSITIVE_CLASS, DataError


@dataclass
class Comparison:
    pairing: DataFrame
    summary: DataFrame
    outcomes: DataFrame
    errors: DataFrame
    confidence: DataFrame


def run(
    a: DataFrame,
    b: DataFrame,
    positive: str = POSITIVE_CLASS,
    replicates: int = pr.REPLICATES,
    expected_rows: int | None = None,
    verify: bool = True,
) -> Comparison:
    """Tables per fraction. With ``verify`` unpaired predictions stop the run."""
    pairing = pr.pairing_report(a, b, expected_rows)
    if verify:
        broken = pairing.where("NOT paired").limit(20).collect()
        if broken:
            raise DataError(f"predictions are not paired: {[r.asDict() for r in broken]}")
    pairs = pr.pair(a, b)
    cells = pr.outcome_cells(pairs, positive)
    outcomes = pr.outcome_counts(pairs)
    statistics = pr.summary(
        pr.observed_delta(cells),
        pr.bootstrap_summary(pr.bootstrap_deltas(cells, replicates)),
        pr.mcnemar(outcomes),
    )
    return Comparison(pairing, statistics, outcomes, pr.error_rows(pairs), pr.confidence_groups(pairs))
