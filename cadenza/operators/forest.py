"""Regression forests with exact splits, for many runs at once.

All trees of all runs grow together: one table keyed (run, tree, node) holds what each tree drew. Nodes with many rows
are split level by level by Spark: every distinct value of every feature is a candidate, weighed by prefix sums over
the sorted values. As soon as a node's rows fit one task its whole subtree grows there, many trees side by side.
Both ways choose the same splits: the largest sum of (sum of labels)^2 / rows over the two sides, of equal ones the
first feature, then the lowest value. Thresholds lie midway between neighbouring values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.numbering import number_within
from cadenza.session import materialize

NODES = "run int, tree int, node long, feature int, threshold double, value double, n long"
#: Node numbers double with every level and are 64-bit.
DEEPEST = 60
#: Rows whose subtrees one task grows, and rows that one task predicts.
ROWS_PER_TASK = 20_000
#: Trees are sent to all executors up to so many nodes (40 MB), counted first; more meet the rows by a shuffle.
SENT_NODES = 1_000_000


def bags(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """What each tree drew: the columns of ``rows`` with tree and weight (how often the row was drawn).

    ``rows`` has run and row_no (1..N within the run). Draw i of a tree takes the row that a hash of (seed, run,
    tree, i) names, so that any cluster draws the same.
    """
    sizes = rows.groupBy("run").agg(F.count("*").alias("_size"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "run", "tree", "row_no"))
    drawn = F.conv(F.substring(draw, 1, 15), 16, 10).cast("long") % F.col("_size") + 1
    taken = (
        rows.select("run", "row_no", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
        .join(sizes, "run")
        .select("run", "tree", drawn.alias("row_no"))
        .groupBy("run", "tree", "row_no")
        .agg(F.count("*").alias("weight"))
    )
    return taken.join(rows, ["run", "row_no"])


def _subtrees(frame: pd.DataFrame, features: list[str], max_depth: int) -> pd.DataFrame:
    """All nodes below (and with) the nodes that the rows are in, a level of all of them at a time."""
    x = frame[features].to_numpy(float).T.copy()
    y, w = frame["label"].to_numpy(float), frame["weight"].to_numpy(float)
    keys, slot = np.unique(frame[["run", "tree", "node"]].to_numpy(np.int64), axis=0, return_inverse=True)
    slot, out = slot.ravel(), []
    while len(keys):
        k = len(keys)
        n, total = np.bincount(slot, w, k), np.bincount(slot, w * y, k)
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        np.minimum.at(low, slot, y)
        np.maximum.at(high, slot, y)
        open_ = (low < high) & (keys[:, 2] < 1 << max_depth)
        best = np.full(k, -np.inf)
        feature, threshold = np.full(k, -1), np.zeros(k)
        rows = np.flatnonzero(open_[slot])
        for f in range(len(features)) if len(rows) else ():
            order = rows[np.lexsort((x[f, rows], slot[rows]))]
            value, at = x[f, order], slot[order]
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            first = new[np.cumsum(np.r_[True, at[1:] != at[:-1]]) - 1]
            cw, cs = np.cumsum(w[order]), np.cumsum(w[order] * y[order])
            left = cw - (cw - w[order])[first]
            sum_left = cs - (cs - w[order] * y[order])[first]
            cut = np.flatnonzero((at[1:] == at[:-1]) & (value[1:] > value[:-1]))
            if not len(cut):
                continue
            here = at[cut]
            right, sum_right = n[here] - left[cut], total[here] - sum_left[cut]
            score = sum_left[cut] * sum_left[cut] / left[cut] + sum_right * sum_right / right
            top = np.lexsort((cut, -score, here))
            top = top[np.r_[True, here[top][1:] != here[top][:-1]]]
            node = here[top]
            better = score[top] > best[node]
            node, top = node[better], top[better]
            best[node], feature[node] = score[top], f
            a, b = value[cut[top]], value[cut[top] + 1]
            middle = (a + b) / 2
            threshold[node] = np.where(middle < b, middle, a)
        out.append(pd.DataFrame({
            "run": keys[:, 0], "tree": keys[:, 1], "node": keys[:, 2], "feature": feature,
            "threshold": threshold, "value": total / n, "n": n.astype(np.int64),
        }))
        rows = np.flatnonzero(feature[slot] >= 0)
        on = slot[rows]
        child = 2 * on + (x[feature[on], rows] > threshold[on])
        kept, slot = np.unique(child, return_inverse=True)
        parent = keys[kept // 2]
        keys = np.c_[parent[:, :2], 2 * parent[:, 2] + kept % 2]
        x, y, w = x[:, rows], y[rows], w[rows]
    return pd.concat(out, ignore_index=True)


def _best_splits(state: DataFrame, totals: DataFrame, features: list[str]) -> DataFrame:
    """run, tree, node, feature, threshold of the best split of every node, from distributed prefix sums."""
    node = ["run", "tree", "node"]
    line = [*node, "feature"]
    numbers = F.array(*[F.col(f).cast("double") for f in features])
    values = (
        state.select(*node, "weight", (F.col("weight") * F.col("label")).alias("_wy"), F.posexplode(numbers).alias("feature", "value"))
        .groupBy(*line, "value")
        .agg(F.sum("weight").alias("_w"), F.sum("_wy").alias("_s"))
    )
    placed = materialize(values.orderBy(*line, "value").withColumn("_part", F.spark_partition_id()), "forest-values")
    earlier = Window.partitionBy(*line).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*line, "_part").agg(F.sum("_w").alias("_w"), F.sum("_s").alias("_s"))
    parts = parts.select(
        *line, "_part",
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"),
    )
    running = Window.partitionBy(*line, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    left, sum_left = F.sum("_w").over(running) + F.col("_w0"), F.sum("_s").over(running) + F.col("_s0")
    cuts = (
        placed.join(parts, [*line, "_part"])
        .select(*line, "value", left.alias("left"), sum_left.alias("sum_left"))
        .join(totals.where("low < high").select(*node, "n", "total"), node)
        .where("left < n")
    )
    right, sum_right = F.col("n") - F.col("left"), F.col("total") - F.col("sum_left")
    score = F.col("sum_left") * F.col("sum_left") / F.col("left") + sum_right * sum_right / right
    best = cuts.groupBy(*node).agg(F.max(F.struct(score.alias("score"), (-F.col("feature")).alias("f"), (-F.col("value")).alias("v"))).alias("_b"))
    best = best.select(*node, (-F.col("_b.f")).alias("feature"), (-F.col("_b.v")).alias("_below"))
    above = placed.join(best, line).where(F.col("value") > F.col("_below")).groupBy(*line, "_below").agg(F.min("value").alias("_above"))
    middle = (F.col("_below") + F.col("_above")) / 2
    return above.select(*line, F.when(middle < F.col("_above"), middle).otherwise(F.col("_below")).alias("threshold"))


def grow(rows: DataFrame, features: list[str], trees: int, seed: int, max_depth: int = DEEPEST, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The nodes of ``trees`` trees per run: run, tree, node (children 2i and 2i + 1), feature, threshold, value, n.

    ``rows`` has run, row_no (1..N per run), ``label`` and the features, all present. Leaves have a null feature.
    Trees grow until their leaves are pure, cannot be split, or lie ``max_depth`` deep.
    """
    max_depth = min(max_depth, DEEPEST)
    node = ["run", "tree", "node"]
    columns = [*node, "weight", F.col("label").cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]]
    state = materialize(bags(rows, trees, seed).withColumn("node", F.lit(1).cast("long")).select(*columns), "forest-rows")
    made: DataFrame | None = None
    for _ in range(max_depth):
        totals = materialize(
            state.groupBy(*node).agg(
                F.count("*").alias("rows"), F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("total"),
                F.min("label").alias("low"), F.max("label").alias("high"),
            ),
            "forest-totals",
        )
        large = totals.where(F.col("rows") > rows_per_task)
        if large.isEmpty():
            break
        large_rows = state.join(large.select(*node), node, "left_semi")
        splits = materialize(_best_splits(large_rows, large, features), "forest-splits")
        decided = large.join(splits, node, "left").select(
            *node, "feature", "threshold", (F.col("total") / F.col("n")).alias("value"), "n"
        )
        made = decided if made is None else made.unionByName(decided)
        value = F.get(F.array(*features), F.col("feature"))
        moved = large_rows.join(splits, node).withColumn("node", 2 * F.col("node") + (value > F.col("threshold")).cast("long"))
        rest = state.join(large.select(*node), node, "left_anti")
        state = materialize(moved.select(state.columns).unionByName(rest), "forest-rows")
    # Small nodes: of whole trees as many as fit one task, of deeper nodes one at a time.
    largest = state.where("node = 1").groupBy("run", "tree").count().agg(F.max("count")).first()[0] or 1
    together = max(1, rows_per_task // largest)
    block = F.floor((F.col("tree") - 1) / together)

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        return _subtrees(frame, features, max_depth)

    small = state.withColumn("_block", block).groupBy("run", "_block", "node").applyInPandas(finish, NODES)
    leaf = F.col("feature") < 0
    small = small.withColumns(
        {"feature": F.when(~leaf, F.col("feature")), "threshold": F.when(~leaf, F.col("threshold"))}
    )
    return materialize(small if made is None else made.select(small.columns).unionByName(small), "forest-nodes")


def _leaf_values(trees: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    """Sum over the given trees of the values of the leaves that each row of ``x`` falls into."""
    total = np.zeros(len(x))
    for _, tree in trees.groupby("tree", sort=True):
        tree = tree.sort_values("node")
        number, feature = tree["node"].to_numpy(np.int64), tree["feature"].fillna(-1).to_numpy(np.int64)
        threshold, value = tree["threshold"].fillna(0.0).to_numpy(float), tree["value"].to_numpy(float)
        down = np.searchsorted(number, 2 * number)
        at, live = np.zeros(len(x), np.int64), np.arange(len(x))
        live = live[feature[at] >= 0]
        while len(live):
            here = at[live]
            at[live] = down[here] + (x[live, feature[here]] > threshold[here])
            live = live[feature[at[live]] >= 0]
        total += value[at]
    return total


@dataclass(frozen=True)
class Forest:
    """A fitted predictor: a stored table of nodes. ``trees`` is how many each run has."""

    nodes: DataFrame
    features: list[str]
    trees: int

    def of_run(self, run: int) -> Forest:
        return Forest(self.nodes.where(F.col("run") == run), self.features, self.trees)

    def _complete(self, df: DataFrame) -> DataFrame:
        return df.na.drop(subset=self.features)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted_count`` by the one run in the model; rows with a missing feature are left out."""
        if self.nodes.count() > SENT_NODES:
            return self.predict_runs(df.withColumn("run", F.lit(self.nodes.first()["run"]))).drop("run")
        trees = self.nodes.select("tree", "node", "feature", "threshold", "value").toPandas()
        n, features = self.trees, self.features

        @F.pandas_udf("double")
        def predicted(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                yield pd.Series(_leaf_values(trees, np.column_stack(columns)) / n)

        inputs = [F.col(f).cast("double") for f in features]
        return self._complete(df).withColumn("predicted_count", predicted(*inputs))

    def predict_runs(self, df: DataFrame) -> DataFrame:
        """Like predict, each row by the trees of its own ``run``: blocks of trees meet chunks of rows."""
        key = F.monotonically_increasing_id()
        rows = materialize(self._complete(df).withColumn("_row", key), "forest-requests")
        chunks = max(1, -(-rows.count() // ROWS_PER_TASK))
        together = 25
        blocks = -(-self.trees // together)
        chunk = F.pmod(F.xxhash64("_row"), F.lit(chunks)).cast("int")

        def every(n: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

        asked = rows.select("run", "_row", chunk.alias("_chunk"), every(blocks).alias("_block"), *self.features)
        block = F.floor((F.col("tree") - 1) / together).cast("int").alias("_block")
        trees = self.nodes.select("*", block, every(chunks).alias("_chunk"))
        features = self.features

        def answer(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            x = mine[features].to_numpy(float)
            return pd.DataFrame({"_row": mine["_row"], "_sum": _leaf_values(theirs, x)})

        keys = ["run", "_chunk", "_block"]
        sums = asked.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(answer, "_row long, _sum double")
        mean = sums.groupBy("_row").agg((F.sum("_sum") / self.trees).alias("predicted_count"))
        return rows.join(mean, "_row").drop("_row")


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with row_no 1..N in their run, in the order of the key."""
    return number_within(rows, ["run"], key, "row_no")
