"""Exact nearest tracks by Euclidean distance or cosine similarity, for a whole request table.

The catalogue is laid out on a quantile grid. Each distinct request first looks into the few cells that
surely hold ``n`` eligible tracks; the n-th best score found there bounds the search, and only cells
that can still beat it are joined in a second round. Both rounds are equi-joins on (cell, block); where a
request needs many cells of one pack of 64, it is sent there once, with a mask of the cells it needs.
Cosine uses the same machinery, because on unit vectors the squared distance is ``2 - 2 * cosine``.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numeric import cosine, euclidean, norm
from cadenza.operators.grid import MAX_CELLS, Grid, box_gaps, box_reach, fit_grid
from cadenza.operators.scaling import Scaler, fit_scaler
from cadenza.session import materialize, spread

PACK = 64  # cells under one mask
_MANY = 8  # near cells from which a pack's mask is sent instead of one row a cell
_SLACK = 1e-9  # widens every bound, so that rounding can only add work, never lose a row


def _in_slices(points: np.ndarray, rows: int, pick: Callable[[np.ndarray, int], list]) -> list:
    found = []
    for start in range(0, len(points), rows):
        found.extend(pick(points[start : start + rows], start))
    return found


def _first_cells(grid: Grid, wanted: int) -> Callable[..., Column]:
    """Nearest cells that together surely hold ``wanted`` eligible rows (all cells if none do)."""
    ids, low, high, sure, rows = grid.ids, grid.low, grid.high, grid.sure, grid.rows_at_once()

    @F.pandas_udf("array<int>")
    def first_cells(*axes: pd.Series) -> pd.Series:
        points = np.column_stack([a.to_numpy(dtype=float) for a in axes])

        def pick(chunk: np.ndarray, _start: int) -> list:
            order = np.argsort((box_reach(chunk, low, high) ** 2).sum(axis=2), axis=1, kind="stable")
            reached = np.cumsum(sure[order], axis=1) >= wanted
            stop = np.where(reached.any(axis=1), reached.argmax(axis=1) + 1, len(ids))
            return [ids[row[:k]].tolist() for row, k in zip(order, stop, strict=True)]

        return pd.Series(_in_slices(points, rows, pick))

    return first_cells


def _cells_within(grid: Grid) -> Callable[..., Column]:
    """Cells closer than ``radius`` that were not searched yet: ``cells``, and ``packs`` with ``masks``.

    Where many cells of one pack are near, a mask over the pack stands for them.
    """
    order = np.argsort(grid.ids)
    ids, low, high, rows = grid.ids[order], grid.low[order], grid.high[order], grid.rows_at_once()
    crowded = grid.rows[order] > grid.rows_per_block
    n_packs = -(-len(ids) // PACK)

    @F.pandas_udf("cells array<int>, packs array<int>, masks array<bigint>")
    def cells_within(radius: pd.Series, searched: pd.Series, *axes: pd.Series) -> pd.DataFrame:
        points = np.column_stack([a.to_numpy(dtype=float) for a in axes])
        limit = radius.to_numpy(dtype=float)

        def pick(chunk: np.ndarray, start: int) -> list:
            gap = np.sqrt((box_gaps(chunk, low, high) ** 2).sum(axis=2))
            near = gap <= limit[start : start + len(chunk), None]
            for row, seen in zip(near, searched.iloc[start : start + len(chunk)], strict=True):
                row[np.searchsorted(ids, seen)] = False
            bits = np.zeros((len(chunk), n_packs * PACK), dtype=bool)
            bits[:, : len(ids)] = near & ~crowded
            bits = bits.reshape(len(chunk), n_packs, PACK)
            many = bits.sum(axis=2) >= _MANY
            masks = np.packbits(bits, axis=2, bitorder="little").view("<i8")[:, :, 0]
            alone = near & ~(np.repeat(many, PACK, axis=1)[:, : len(ids)] & ~crowded)
            return [
                (ids[a].tolist(), np.flatnonzero(m).tolist(), mask[m].tolist())
                for a, m, mask in zip(alone, many, masks, strict=True)
            ]

        return pd.DataFrame(_in_slices(points, rows, pick), columns=["cells", "packs", "masks"])

    return cells_within


def nearest(
    requests: DataFrame,
    catalogue: DataFrame,
    features: list[str],
    n: int,
    metric: str = "euclidean",
    exclude_same_title: bool = False,
    exclude_self: bool = False,
    scaler: Scaler | None = None,
    rows_per_cell: int = 64,
    max_cells: int = MAX_CELLS,
    rows_per_block: int = 50_000,
) -> DataFrame:
    """The ``n`` nearest catalogue tracks of each request: request_id, rank, track_id, score.

    ``requests`` has request_id, title, track_id (may be NULL) and the features; ``catalogue`` has id,
    name and the features, all present. ``score`` is the distance (lower is nearer) or the cosine
    similarity (higher is nearer); ties go to the lower id.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    by_cosine = metric == "cosine"
    scaler = scaler or fit_scaler(catalogue, features)
    z = [f"z{i}" for i in range(len(features))]
    u = [f"u{i}" for i in range(len(features))] if by_cosine else z
    title = [F.lower("name").alias("item_title")] if exclude_same_title else []

    def vectors(df: DataFrame, *others: Column) -> DataFrame:
        out = df.select(*others, *[s.alias(a) for s, a in zip(scaler.all_scaled(), z, strict=True)])
        if by_cosine:
            out = out.withColumn("size", norm([F.col(a) for a in z]))
            unit = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.col("size"))
            out = out.withColumns({b: F.col(a) / unit for a, b in zip(z, u, strict=True)})
        return out

    self_key = ["self_id"] if exclude_self else []
    title_key = ["query_title"] if exclude_same_title else []
    query_key = [*z, *title_key, *self_key]

    def store_requests() -> tuple[DataFrame, DataFrame]:
        """All requests, and the distinct ones: equal requests are answered once."""
        rows = materialize(
            vectors(
                requests,
                F.col("request_id"),
                *([F.lower("title").alias("query_title")] if exclude_same_title else []),
                *([F.col("track_id").alias("self_id")] if exclude_self else []),
            ),
            "neighbour-requests",
        )
        distinct = rows.groupBy(*query_key, *([*u, "size"] if by_cosine else [])).agg(
            F.min("request_id").alias("query_id")
        )
        return rows, materialize(distinct, "neighbour-queries")

    side = ThreadPoolExecutor(max_workers=1)  # the request side does not wait for the catalogue side
    stored = side.submit(store_requests)

    # Copies of one vector tie everywhere, so only their lowest ids can be answers: `keep` of them (one
    # more than n where the request itself may be among them). Where one title is left out, `keep` per
    # title and then the first 2 * keep of those are enough, as at most `keep` of them have that title.
    # Each limit is applied before its shuffle as well as after it.
    keep = n + 1 if exclude_self else n
    limits = [(["item_title"], keep), ([], 2 * keep)] if exclude_same_title else [([], keep)]
    items = vectors(catalogue, F.col("id").alias("item_id"), *title)
    for more_keys, limit in limits:
        copies = Window.partitionBy(*z, *more_keys).orderBy("item_id")
        items = (
            items.withColumn("_copy", F.row_number().over(copies))
            .where(F.col("_copy") <= limit)
            .drop("_copy")
        )
    items = materialize(items, "neighbour-items")
    grid = fit_grid(items, u, rows_per_cell, max_cells, rows_per_block)
    items = items.withColumn("cell", grid.cell())
    grid.measure(items, "item_title" if exclude_same_title else None)
    items = items.withColumn(
        "block", F.pmod(F.xxhash64("item_id"), grid.blocks(F.col("cell"))).cast("int")
    )

    asked, queries = stored.result()
    side.shutdown()

    eligible = F.lit(True)
    if exclude_same_title:
        eligible = eligible & ~F.coalesce(F.col("query_title") == F.col("item_title"), F.lit(False))
    if exclude_self:
        eligible = eligible & ~F.coalesce(F.col("self_id") == F.col("item_id"), F.lit(False))
    mine, theirs = [F.col(f"q.{a}") for a in z], [F.col(f"i.{a}") for a in z]
    if by_cosine:
        score = cosine(mine, theirs, F.col("q.size"), F.col("i.size"))
        order = [F.col("score").desc(), F.col("item_id")]
        worst, no_bound = F.min("score"), F.lit(-2.0)
        still_good = F.col("score") >= F.col("bound") - _SLACK
        radius = F.sqrt(F.greatest(2 - 2 * (F.col("bound") - _SLACK), F.lit(0.0))) + _SLACK
    else:
        score = euclidean(mine, theirs)
        order = [F.col("score"), F.col("item_id")]
        worst, no_bound = F.max("score"), F.lit(float("inf"))
        still_good = F.col("score") <= F.col("bound") * (1 + _SLACK) + _SLACK
        radius = F.col("bound") * (1 + _SLACK) + _SLACK
    best = Window.partitionBy("query_id").orderBy(*order)

    def compare(search: DataFrame) -> DataFrame:
        """Score each (query, cell) row against the tracks of that cell."""
        cells = spread(search, "query_id", "cell").withColumn(
            "block", F.explode(F.sequence(F.lit(0), grid.blocks(F.col("cell")) - 1))
        )
        return (
            cells.alias("q")
            .join(items.alias("i"), ["cell", "block"])
            .where(eligible)
            .withColumn("score", score)
        )

    def compare_packs(search: DataFrame) -> DataFrame:
        """Score each (query, pack, mask) row against the tracks of the masked cells."""
        parts = int(search.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shares = -(-parts // max(1, -(-len(grid.ids) // PACK)))  # few packs are read by several tasks each
        place = grid.place(F.col("cell"))
        asked_packs = search.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)))
        packed = items.withColumns(
            {
                "pack": F.floor(place / PACK).cast("int"),
                "bit": (place % PACK).cast("int"),
                "share": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))),
            }
        )
        return (
            spread(asked_packs, "pack", "share")
            .alias("q")
            .join(spread(packed, "pack", "share").alias("i"), ["pack", "share"])
            .where((F.getbit(F.col("q.mask"), F.col("i.bit")) == 1) & eligible)
            .withColumn("score", score)
        )

    axes = [F.col(a) for a in u]
    first = _first_cells(grid, keep)
    near = (
        compare(queries.withColumn("cell", F.explode(first(*axes))))
        .select("query_id", "item_id", "score")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .groupBy("query_id")
        .agg(
            F.collect_list(F.struct("item_id", "score")).alias("hits"),  # at most n
            F.when(F.count("*") >= n, worst).otherwise(no_bound).alias("bound"),
        )
    )
    near = materialize(
        queries.withColumn("searched", first(*axes))
        .join(near, "query_id", "left")
        .withColumn("bound", F.coalesce("bound", no_bound)),
        "neighbour-bounds",
    )
    left = near.withColumn("left", _cells_within(grid)(radius, F.col("searched"), *axes))
    compared = ["query_id", *query_key, *(["size"] if by_cosine else []), "bound"]
    by_cell = left.select(*compared, F.explode("left.cells").alias("cell"))
    by_pack = left.select(
        *compared, F.inline(F.arrays_zip("left.packs", "left.masks")).alias("pack", "mask")
    )
    wider = (
        compare(by_cell)
        .where(still_good)
        .select("query_id", "item_id", "score")
        .unionByName(compare_packs(by_pack).where(still_good).select("query_id", "item_id", "score"))
    )
    ranked = (
        near.select("query_id", F.inline("hits"))
        .unionByName(wider)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
    )
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in query_key]
    answers = asked.alias("a").join(queries.alias("b"), same).select("a.request_id", "b.query_id")
    return answers.join(ranked, "query_id").select(
        "request_id", "rank", F.col("item_id").alias("track_id"), "score"
    )


def with_names(hits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Attach name and artists to (request_id, rank, track_id, score) rows."""
    names = catalogue.select(F.col("id").alias("track_id"), "name", "artists")
    return hits.join(names, "track_id").select(
        "request_id", "rank", "track_id", "name", "artists", "score"
    )
