"""Mixing sources to target weights by entropy balancing.

Rates minimise the relative entropy to taking every document once, subject to each source's words meeting its
target. The dual has one multiplier per source; Newton steps find it, with sums over all documents taken by
Spark in every step. A document's rate is exp(multiplier * tilt), at most 3; its tilt
``size / (size + average size of the source)`` follows from the base mass ``size + average``. Rates are
then rounded to copies, from the longest document of a block to the shortest, carrying the error along.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import row_key, text_or_empty, unused
from cadenza.session import materialize

MOST_COPIES = 3
WEIGHTS = (5, 2, 1)
#: Documents that one task rounds together; larger sources are dealt into blocks by a hash of the document.
BLOCK = 8_192


def word_count(text: str = "text"):
    """Runs of other characters than blank and 0x09-0x0D; 0 for null."""
    cleaned = F.translate(text_or_empty(text), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(cleaned, " "), lambda w: w != F.lit(""))).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Words per source: shares of the whole by weight, none above ``most`` times its size, the excess reshared."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, fixed = float(sum(sizes.values())), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            return fixed | {s: unit * weight[s] for s in open_}
        for s in full:
            fixed[s] = float(most * sizes[s])
            left -= fixed[s]
        open_ = [s for s in open_ if s not in fixed]
    return fixed


def _multipliers(rows: DataFrame, stats: pd.DataFrame, goal: dict, steps: int = 40) -> dict:
    """Roots of the dual's gradient, one per source; Newton steps kept inside a shrinking bracket."""
    spark = rows.sparkSession
    keys = [None if pd.isna(s) else s for s in stats["source"]]
    size = dict(zip(keys, stats["words"]))
    found = {s: 0.0 for s in keys}
    low, high = {s: -200.0 for s in keys}, {s: 200.0 for s in keys}
    live = {s for s in keys if size[s] > 0 and goal[s] < MOST_COPIES * size[s] * (1 - 1e-12)}
    for s in keys:
        if s not in live:
            found[s] = high[s]
    for _ in range(steps):
        if not live:
            break
        now = spark.createDataFrame([(s, found[s]) for s in live], "_s string, _m double")
        rate = F.exp(F.col("_m") * F.col("tilt"))
        sums = (
            rows.join(F.broadcast(now), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(float(MOST_COPIES)))).alias("taken"),
                F.sum(F.when(rate < MOST_COPIES, F.col("n") * F.col("size") * F.col("tilt") * rate).otherwise(0.0)).alias("slope"),
            )
            .collect()
        )
        for row in sums:
            s, gap = row["source"], row["taken"] - goal[row["source"]]
            if abs(gap) <= 1e-9 * max(goal[s], 1.0):
                live.discard(s)
                continue
            if gap > 0:
                high[s] = found[s]
            else:
                low[s] = found[s]
            step = found[s] - gap / row["slope"] if row["slope"] > 0 else math.inf
            found[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return found


def round_rates(size: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Copies, each its rate rounded down or up, whose words come near those of the rates. Sizes descend."""
    down, up = np.floor(rate).astype(np.int64), np.minimum(np.ceil(rate), MOST_COPIES).astype(np.int64)
    copies, owed = down.copy(), 0.0
    for i, (words, wanted) in enumerate(zip(size.tolist(), rate.tolist())):
        if words and wanted + owed / words >= down[i] + 0.5:
            copies[i] = up[i]
        owed += (wanted - copies[i]) * words
    for _ in range(32):  # single changes that bring the sum nearer
        change = np.where(copies == down, up - down, down - up) * size
        left = np.abs(owed - change)
        best = int(np.argmin(left)) if len(left) else 0
        if not len(left) or left[best] >= abs(owed):
            break
        owed -= change[best]
        copies[best] = up[best] if copies[best] == down[best] else down[best]
    return copies


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Returns doc_id, source, size, source_size, target, rate, copies, taken, one row per input row.

    A null or blank text has size 0 and rate 1; it adds no words. A null source is a source of its own, last.
    Repeated rows are separate documents. The per-source totals (one row a source) go through the driver. A
    source whose target is 0 takes nothing. An empty table gives no rows. Other columns are ignored.
    """
    return _mixed(documents, weights).drop("key")


def repeat(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents, with all their columns, each as often as the mix takes it.

    Rows that repeat id, text and source share the copies that the mix gives them all: each gets the whole part of the
    division, and as many of them as remain get one more.
    """
    key, times, left, number, part, before = (unused(documents, c) for c in ("_key", "_copies", "_left", "_number", "_part", "_before"))
    named = lambda row: F.xxhash64(row, F.col("source").isNull(), F.col("source")).alias(key)
    copies = _mixed(documents, weights).groupBy(named(F.col("key"))).agg(F.sum("copies").alias("sum"), F.count("*").alias("n"))
    whole, rest = F.floor(F.col("sum") / F.col("n")).cast("int").alias(times), (F.col("sum") % F.col("n")).alias(left)
    copies = materialize(copies.where("sum > 0").select(key, whole, rest), "mix-copies")
    keyed = documents.withColumn(key, named(row_key()))
    taken = keyed.join(copies.where(F.col(left) == 0).hint("shuffle_hash"), key).drop(left)
    uneven = copies.where(F.col(left) > 0)
    if not uneven.isEmpty():
        # Rows of a key are numbered per part of the written table, then by how many the parts before hold.
        rows = materialize(keyed.join(uneven.hint("shuffle_hash"), key).withColumn(number, F.monotonically_increasing_id()), "mix-uneven")
        rows = rows.withColumn(part, F.shiftright(number, 33))
        held = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy(key, part).agg(F.count("*").alias("n"))
        counts = counts.select(key, part, F.coalesce(F.sum("n").over(held), F.lit(0)).alias(before))
        rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(key, part).orderBy(number))).join(counts, [key, part])
        more = (F.col(before) + F.col(number) <= F.col(left)).cast("int")
        rows = rows.withColumn(times, F.col(times) + more).where(F.col(times) > 0)
        taken = taken.unionByName(rows.select(taken.columns))
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(documents.columns)


def _mixed(documents: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    spark = documents.sparkSession
    rows = materialize(documents.select("doc_id", "source", row_key().alias("key"), word_count().alias("size")), "mix-sizes")
    stats = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).toPandas()
    stats = stats.astype({"source": object})
    keys = [None if pd.isna(s) else s for s in stats["source"]]
    goal = targets(dict(zip(keys, map(int, stats["words"]))), weights)
    per_source = spark.createDataFrame(
        [(s, int(w), float(goal[s]), max(float(w) / d, 1e-9), 1 + int(d) // BLOCK) for s, w, d in zip(keys, stats["words"], stats["docs"])],
        "_s string, source_size long, target double, _mean double, _blocks long",
    )
    same = F.col("source").eqNullSafe(F.col("_s"))
    tilt = F.col("size") / (F.col("size") + F.col("_mean"))
    histogram = materialize(
        rows.groupBy("source", "size").agg(F.count("*").alias("n")).join(F.broadcast(per_source), same).withColumn("tilt", tilt).drop("_s"),
        "mix-histogram",
    )
    found = _multipliers(histogram, stats.assign(source=keys), goal)
    solved = per_source.join(
        F.broadcast(spark.createDataFrame(list(found.items()), "_t string, _m double")), F.col("_s").eqNullSafe(F.col("_t"))
    ).drop("_t")
    rated = (
        rows.join(F.broadcast(solved), same)
        .withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.exp(F.col("_m") * tilt), F.lit(float(MOST_COPIES)))))
        .withColumn("_block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("_blocks")))
        .drop("_s", "_m", "_mean", "_blocks")
    )
    schema = "doc_id string, key long, source string, size long, source_size long, target double, rate double, copies long, taken long"

    def round_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        size, rate = pdf["size"].to_numpy(np.int64), pdf["rate"].to_numpy(float)
        copies = round_rates(size, rate)
        return pdf.assign(copies=copies, taken=copies * size)[[c.split()[0] for c in schema.split(", ")]]

    # Small columns only; the sort by size lets the shortest documents settle what the longest leave. Ids travel as text:
    # pandas would make floats of whole numbers beside a null.
    rounded = rated.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("source", "_block").applyInPandas(round_block, schema)
    return rounded.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))
