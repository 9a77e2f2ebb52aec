"""Best fuzzy title for each request, exact over all titles without comparing all pairs.

1. Equal cleaned texts score 100 and need no search.
2. Every other request is compared with the titles of its closest grid cell, giving a score to beat.
3. Only cells, and within them only titles, whose upper bound reaches that score are compared.

Requests are sorted by text and searched in chunks. A task compares one chunk with the wanted titles of one
pack of cells, and walks a beginning that the chunk's texts share once (``fuzzy.common_matrix``).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.fuzzy import (
    CLASSES,
    as_ratio,
    common_lengths,
    common_matrix,
    shared_at_most,
    signature_of,
    text_signature,
)
from cadenza.functions.text import cleaned
from cadenza.operators.grid import MAX_CELLS, Grid, box_gaps, fit_grid
from cadenza.session import materialize, spread

# Fixed value: scores below this are flagged as weak.
WEAK_BELOW = 40

_AXES = ["length", *[f"class{i}" for i in range(len(CLASSES))]]
# Up to this length no text other than an equal one can round to 100.
_EQUAL_ONLY = 98
_CHUNK = 4096  # requests searched together
_TILE = 131_072  # pairs compared in one step, counting each 64 characters of a title
_SLACK = 0.5 + 1e-6  # what rounding may add to a score


def _closest_cell(grid: Grid) -> Callable[..., Column]:
    ids, low, high, rows = grid.ids, grid.low, grid.high, grid.rows_at_once()

    @F.pandas_udf("int")
    def closest_cell(*axes: pd.Series) -> pd.Series:
        points = np.column_stack([a.to_numpy(dtype=float) for a in axes])
        middle = (low + high) / 2
        found = []
        for start in range(0, len(points), rows):
            away = np.abs(points[start : start + rows, None, :] - middle[None]).sum(axis=2)
            found.append(ids[away.argmin(axis=1)])
        return pd.Series(np.concatenate(found).astype(np.int32))

    return closest_cell


def _reachable(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Highest score that any title of each box could have with each point."""
    length = points[:, :1]
    apart = box_gaps(points[:, 1:], low[:, 1:], high[:, 1:]).sum(axis=2)
    shared = np.minimum(points[:, None, 1:], high[None, :, 1:]).sum(axis=2)
    shortest, longest = length + low[None, :, 0], length + high[None, :, 0]
    by_gap = 1 - apart / np.maximum(longest, 1)
    by_share = 2 * shared / np.maximum(shortest, 1)
    return 100 * np.minimum(np.minimum(by_gap, by_share), 1.0) + _SLACK


def _cells_reaching(grid: Grid) -> Callable[..., Column]:
    """Cells in which some title could still score at least ``bound``, other than the one searched."""
    ids, low, high, rows = grid.ids, grid.low, grid.high, grid.rows_at_once()

    @F.pandas_udf("array<int>")
    def cells_reaching(bound: pd.Series, searched: pd.Series, *axes: pd.Series) -> pd.Series:
        points = np.column_stack([a.to_numpy(dtype=float) for a in axes])
        wanted, seen = bound.to_numpy(dtype=float), searched.to_numpy()
        found: list[list[int]] = []
        for start in range(0, len(points), rows):
            p = points[start : start + rows]
            reach = _reachable(p, low, high) >= wanted[start : start + len(p), None]
            reach &= ids[None, :] != seen[start : start + len(p), None]
            found.extend(ids[row].tolist() for row in reach)
        return pd.Series(found)

    return cells_reaching


def _ratios(asked: np.ndarray, titles: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Scores of all wanted pairs; of others either the score or -1."""
    if 8 * np.count_nonzero(want) >= want.size:
        common = common_matrix(asked, titles)
        size = np.array([len(a) for a in asked])[:, None] + np.array([len(t) for t in titles])[None]
        return as_ratio(common, size)
    scores = np.full(want.shape, -1, dtype=np.int32)
    a, t = np.nonzero(want)
    scores[a, t] = as_ratio(*common_lengths(pd.Series(asked[a]), pd.Series(titles[t])))
    return scores


def _best_of_pack(searched_only: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Best title of each request of a chunk, among the titles given of one pack of cells.

    Looks only into the cell under ``searched``, or only into all others.
    """

    def best_of_pack(asked: pa.Table, titles: pa.Table) -> pa.Table:
        asked = asked.take(pc.sort_indices(asked["clean"]))
        titles = titles.take(pc.sort_indices(titles["track_id"], null_placement="at_start"))
        a_text = np.array(asked["clean"].to_pylist(), dtype=object)
        t_text = np.array(titles["clean"].to_pylist(), dtype=object)
        a_sign, t_sign = signature_of(pd.Series(a_text, dtype=object)), signature_of(pd.Series(t_text, dtype=object))
        a_axes, t_axes = a_sign[_AXES].to_numpy(dtype=float), t_sign[_AXES].to_numpy(dtype=float)
        searched, cell = asked["searched"].to_numpy(), titles["cell"].to_numpy()
        limit = asked["bound"].to_numpy().astype(np.int32)  # a score to reach, raised by every find
        place = np.full(len(a_text), -1)
        for c in np.unique(cell):
            inside = np.flatnonzero(cell == c)
            box = t_axes[inside]
            rows = np.flatnonzero((searched == c) == searched_only)
            reach = _reachable(a_axes[rows], box.min(axis=0)[None], box.max(axis=0)[None])[:, 0]
            rows = rows[reach >= limit[rows]]
            words = max(1, -(-int(box[:, 0].max()) // 64))
            wide = min(128, len(inside))
            step = max(1, _TILE // (words * wide))
            for t in range(0, len(inside), wide):
                theirs = inside[t : t + wide]
                length = t_axes[theirs, 0]
                for a in range(0, len(rows), step):
                    mine = rows[a : a + step]
                    shared = shared_at_most(a_sign.iloc[mine], t_sign.iloc[theirs])
                    size = np.maximum(a_axes[mine, :1] + length[None], 1)
                    want = 200.0 * shared / size + _SLACK >= limit[mine, None]
                    some, to = np.flatnonzero(want.any(axis=1)), np.flatnonzero(want.any(axis=0))
                    if not len(some):
                        continue
                    mine, to = mine[some], theirs[to]
                    scores = _ratios(a_text[mine], t_text[to], want[some][:, want.any(axis=0)])
                    at = scores.argmax(axis=1)  # of equal scores the first, which has the lowest track id
                    score, at = scores[np.arange(len(mine)), at], to[at]
                    better = (score > limit[mine]) | (
                        (score == limit[mine]) & ((place[mine] < 0) | (at < place[mine]))
                    )
                    limit[mine[better]], place[mine[better]] = score[better], at[better]
        found = np.flatnonzero(place >= 0)
        return pa.table(
            {
                "query_id": asked["query_id"].take(found),
                "track_id": titles["track_id"].take(place[found]),
                "score": pa.array(limit[found], pa.int32()),
            }
        )

    return best_of_pack


def best_matches(
    requests: DataFrame,
    titles: DataFrame,
    rows_per_cell: int = 64,
    max_cells: int = MAX_CELLS,
    rows_per_block: int = 50_000,
) -> DataFrame:
    """request_id, track_id, match_score (0-100) and is_weak_match for every request.

    ``requests`` has request_id and search_text, ``titles`` has track_id and search_text. Texts are
    compared after cleaning; equal scores go to the lowest track id.
    """

    def sign(df: DataFrame) -> DataFrame:
        return df.withColumn("sign", text_signature("clean")).select(*df.columns, "sign.*")

    def text(df: DataFrame) -> DataFrame:
        return df.withColumn("clean", F.coalesce(cleaned("search_text"), F.lit("")))

    side = ThreadPoolExecutor(max_workers=1)  # the request side does not wait for the title side
    stored = side.submit(
        materialize,
        text(requests.select("request_id", "search_text")).select("request_id", "clean"),
        "fuzzy-requests",
    )
    known = materialize(
        sign(text(titles).groupBy("clean").agg(F.min("track_id").alias("track_id"))), "fuzzy-titles"
    )
    grid = fit_grid(known, _AXES, rows_per_cell, max_cells, rows_per_block)
    known = known.withColumn("cell", grid.cell())
    grid.measure(known)
    known = known.withColumn(
        "block", F.pmod(F.xxhash64("clean"), grid.blocks(F.col("cell"))).cast("int")
    )

    asked = stored.result()
    side.shutdown()
    queries = asked.groupBy("clean").agg(F.min("request_id").alias("query_id"))
    equal = queries.join(
        known.select("clean", F.col("track_id").alias("equal_id")), "clean", "left"
    ).withColumn("equal_id", F.when(F.col("clean") != "", F.col("equal_id")))
    settled = F.col("equal_id").isNotNull() & (F.length("clean") <= _EQUAL_ONLY)
    done = equal.where(settled).select("query_id", F.col("equal_id").alias("track_id"), F.lit(100).alias("score"))
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first_cell = _closest_cell(grid)(*[F.col(a) for a in _AXES])
    open_queries = materialize(
        sign(equal.where(~settled).repartitionByRange(parts, "clean").sortWithinPartitions("clean"))
        .withColumn("searched", first_cell)
        .withColumn("chunk", F.floor(F.monotonically_increasing_id() / _CHUNK)),
        "fuzzy-open",
    )

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "track_id")
    first, last = grid.packs()
    ids = [asked.schema["request_id"].dataType, known.schema["track_id"].dataType]
    layout = f"query_id {ids[0].simpleString()}, track_id {ids[1].simpleString()}, score int"

    def compare(search: DataFrame, searched_only: bool) -> DataFrame:
        """Best title in each pack, of the cells in the array ``cells``, for each request."""
        wanted = search.select(F.col("chunk").alias("of_chunk"), F.explode("cells").alias("cell")).distinct()
        theirs = wanted.join(known, "cell").select(
            "of_chunk", (first(F.col("cell")) + F.col("block")).alias("pack"), "cell", "clean", "track_id"
        )
        packs = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.sequence(first(c), last(c)))))
        mine = search.select(
            "chunk", F.explode(packs).alias("pack"), "query_id", "clean", "searched", "bound"
        )
        return (
            spread(mine, "chunk", "pack")
            .groupBy("chunk", "pack")
            .cogroup(spread(theirs, "of_chunk", "pack").groupBy("of_chunk", "pack"))
            .applyInArrow(_best_of_pack(searched_only), layout)
        )

    tried = (
        compare(
            open_queries.withColumns({"cells": F.array("searched"), "bound": F.lit(0)}), searched_only=True
        )
        .withColumn("nth", F.row_number().over(best))
        .where(F.col("nth") == 1)
        .select("query_id", F.col("track_id").alias("tried_id"), F.col("score").alias("tried_score"))
    )
    equal_score = F.when(F.col("equal_id").isNotNull(), F.lit(100)).otherwise(F.lit(0))
    begun = materialize(
        open_queries.join(tried, "query_id", "left").withColumn(
            "bound", F.greatest(equal_score, F.coalesce("tried_score", F.lit(0)))
        ),
        "fuzzy-bounds",
    )
    reaching = _cells_reaching(grid)(F.col("bound"), F.col("searched"), *[F.col(a) for a in _AXES])
    rest = compare(begun.withColumn("cells", reaching), searched_only=False)
    winners = (
        done.unionByName(
            begun.where(F.col("tried_id").isNotNull()).select(
                "query_id", F.col("tried_id").alias("track_id"), F.col("tried_score").alias("score")
            )
        )
        .unionByName(
            begun.where(F.col("equal_id").isNotNull()).select(
                "query_id", F.col("equal_id").alias("track_id"), F.lit(100).alias("score")
            )
        )
        .unionByName(rest)
        .withColumn("nth", F.row_number().over(best))
        .where(F.col("nth") == 1)
        .select("query_id", "track_id", F.col("score").alias("match_score"))
    )
    return (
        asked.join(queries, "clean")
        .join(winners, "query_id")
        .select(
            "request_id",
            "track_id",
            "match_score",
            (F.col("match_score") < WEAK_BELOW).alias("is_weak_match"),
        )
    )
