"""Population scaling fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each feature; a constant feature has scale 1."""
    columns = []
    for name in names:
        std = F.stddev_pop(name)
        columns += [
            F.avg(name).alias(f"{name}__mean"),
            F.when(std > 1e-12, std).otherwise(1.0).alias(f"{name}__std"),
        ]
    return train.agg(*columns)


def apply_scaler(rows: DataFrame, scaler: DataFrame, names: Sequence[str]) -> DataFrame:
    """Standardize with a fitted scaler; its single row is read once on the driver as constants."""
    fitted = scaler.first()
    return rows.withColumns(
        {n: (F.col(n) - fitted[f"{n}__mean"]) / fitted[f"{n}__std"] for n in names}
    )


def standardized(rows: DataFrame, names: Sequence[str], train_condition: str = "split = 'train'") -> DataFrame:
    return apply_scaler(rows, fit_scaler(rows.where(train_condition), names), names)
