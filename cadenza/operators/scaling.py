"""Standardisation with population statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numeric import zscore


@dataclass(frozen=True)
class Scaler:
    """Per-column mean and population deviation, learned once and reused for every request table."""

    columns: list[str]
    means: list[float]
    stds: list[float]

    def scaled(self, column: str) -> Column:
        i = self.columns.index(column)
        return zscore(F.col(column), self.means[i], self.stds[i])

    def all_scaled(self) -> list[Column]:
        return [self.scaled(c) for c in self.columns]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.columns})


def scaling_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``<column>_mean`` and ``<column>_std`` (population) for each column."""
    stats = []
    for c in columns:
        stats.append(F.avg(F.col(c).cast("double")).alias(f"{c}_mean"))
        stats.append(F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_std"))
    return df.agg(*stats)


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    row = scaling_statistics(df, columns).first()
    if row is None or row[f"{columns[0]}_mean"] is None:
        raise ValueError("cannot standardise an empty table")
    return Scaler(
        list(columns),
        [row[f"{c}_mean"] for c in columns],
        [row[f"{c}_std"] for c in columns],
    )
