"""Quantile grid over numeric columns, used to narrow similarity joins to nearby cells.

A grid never decides a result: it only bounds how close any row of a cell can be, so that cells which
cannot hold an answer are skipped. The per-cell facts kept on the driver are limited by ``MAX_CELLS``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 16_384
_FINEST = 16  # most slices of one column
_BOX_VALUES = 2_000_000  # numbers in one point-by-box array


@dataclass
class Grid:
    columns: list[str]
    edges: list[list[float]]
    rows_per_block: int
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    rows: np.ndarray | None = None
    sure: np.ndarray | None = None

    def cell(self) -> Column:
        """Cell number of a row: one slice number per column, read as digits."""
        number = F.lit(0)
        for column, cuts in zip(self.columns, self.edges, strict=True):
            piece = F.lit(0)
            for cut in cuts:
                piece = piece + (F.col(column) > F.lit(cut)).cast("int")
            number = number * (len(cuts) + 1) + piece
        return number

    def rows_at_once(self) -> int:
        """Points compared with all boxes in one step, so that the temporary arrays stay small."""
        return max(1, _BOX_VALUES // max(1, len(self.ids) * len(self.columns)))

    def blocks(self, cell: Column) -> Column:
        """Into how many blocks the rows of a cell are split (1 unless the cell is crowded)."""
        if not len(self.rows) or self.rows.max() <= self.rows_per_block:
            return F.lit(1)
        per_cell = np.ones(int(self.ids.max()) + 1, dtype=np.int64)
        per_cell[self.ids] = -(-self.rows // self.rows_per_block)
        # One constant array, folded when the query is planned and read by position.
        table = F.split(F.lit(",".join(map(str, per_cell))), ",").cast("array<int>")
        return F.coalesce(F.get(table, cell), F.lit(1))

    def place(self, cell: Column) -> Column:
        """Place of a cell among the occupied ones, from 0; rows that miss a value are in no cell."""
        places = np.zeros(int(self.ids.max(initial=0)) + 1, dtype=np.int64)
        for at, occupied in enumerate(np.sort(self.ids).tolist()):
            if occupied >= 0:
                places[occupied] = at
        return F.get(F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>"), cell)

    def packs(self) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
        """First and last pack of a cell, as functions of the cell column.

        Neighbouring cells share a pack of at most ``rows_per_block`` rows; a crowded cell has as many
        packs as it has blocks.
        """
        first = np.zeros(int(self.ids.max(initial=0)) + 1, dtype=np.int64)
        last = first.copy()
        pack, room = -1, 0
        for cell, rows in sorted(zip(self.ids.tolist(), self.rows.tolist(), strict=True)):
            if rows > room:
                pack, room = pack + 1, self.rows_per_block
            first[cell], last[cell] = pack, pack + max(0, -(-rows // self.rows_per_block) - 1)
            pack, room = last[cell], room - rows
        tables = [F.split(F.lit(",".join(map(str, t))), ",").cast("array<int>") for t in (first, last)]
        return tuple(lambda cell, table=table: F.get(table, cell) for table in tables)

    def measure(self, items: DataFrame, label: str | None = None) -> "Grid":
        """Learn bounds and row counts per occupied cell from ``items`` (which has a ``cell`` column).

        ``sure`` counts the rows left in a cell whatever single ``label`` is excluded from it.
        """
        ranges = [f(c).alias(f"{n}_{c}") for c in self.columns for n, f in (("lo", F.min), ("hi", F.max))]
        by_label = ["cell"] if label is None else ["cell", label]
        part = items.groupBy(*by_label).agg(F.count("*").alias("n"), *ranges)
        again = [
            f(f"{n}_{c}").alias(f"{n}_{c}")
            for c in self.columns
            for n, f in (("lo", F.min), ("hi", F.max))
        ]
        largest = F.lit(0) if label is None else F.max("n")
        cells = (
            part.groupBy("cell")
            .agg(F.sum("n").alias("rows"), (F.sum("n") - largest).alias("sure"), *again)
            .toPandas()
        )
        self.ids = cells["cell"].to_numpy(dtype=np.int64)
        self.rows = cells["rows"].to_numpy(dtype=np.int64)
        self.sure = cells["sure"].to_numpy(dtype=np.int64)
        self.low = cells[[f"lo_{c}" for c in self.columns]].to_numpy(dtype=float)
        self.high = cells[[f"hi_{c}" for c in self.columns]].to_numpy(dtype=float)
        return self


def fit_grid(
    df: DataFrame,
    columns: list[str],
    rows_per_cell: int = 64,
    max_cells: int = MAX_CELLS,
    rows_per_block: int = 50_000,
) -> Grid:
    """Choose slice boundaries from approximate quantiles; more rows give more, equally full cells."""
    fractions = [i / _FINEST for i in range(1, _FINEST)]
    marks = F.array(*[F.lit(f) for f in fractions])
    row = df.agg(
        F.count("*").alias("n"),
        *[F.percentile_approx(c, marks, 1000).alias(c) for c in columns],
    ).first()
    target = min(max_cells, max(1, row["n"] // rows_per_cell))
    slices = [1] * len(columns)
    while True:
        grown = False
        for i in range(len(columns)):
            if slices[i] < _FINEST and int(np.prod(slices)) * 2 <= target:
                slices[i] *= 2
                grown = True
        if not grown:
            break
    edges = []
    for column, n in zip(columns, slices, strict=True):
        quantiles = row[column] or []
        step = _FINEST // n
        edges.append(sorted({float(quantiles[i]) for i in range(step - 1, len(quantiles), step)}))
    return Grid(list(columns), edges, rows_per_block)


def box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per-column distance from each point to each box (0 inside); shape points x boxes x columns."""
    p = points[:, None, :]
    return np.maximum(np.maximum(low[None] - p, p - high[None]), 0.0)


def box_reach(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per-column distance from each point to the far side of each box."""
    p = points[:, None, :]
    return np.maximum(np.abs(p - low[None]), np.abs(high[None] - p))
