"""Row numbers without a single-task window.

``row_number()`` over a whole table, or over one very large group, runs in one task. Both helpers
here spread the work and then add an offset per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import materialize

_HEX_DIGITS = 3  # 16**3 = 4,096 hash slices


def _offsets(counts: DataFrame, slice_col: str) -> DataFrame:
    """Rows before each slice and in total. ``counts`` has one row per slice, never one per input row."""
    before = Window.orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(slice_col).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return counts.select(
        slice_col,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(everything).alias("_total"),
    )


def number_rows(df: DataFrame, order_by: list[Column | str], name: str = "row_no") -> DataFrame:
    """Number all rows 1..N in the given order.

    The rows are range-partitioned by the sort, written once, and each sorted part is shifted by the
    size of the parts before it. The offsets have one row per part, hence the broadcast.
    """
    slot = F.col("_slot")
    placed = materialize(
        df.orderBy(*order_by).withColumn("_slot", F.monotonically_increasing_id()), "numbered"
    ).withColumn("_part", F.shiftright(slot, 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = F.broadcast(_offsets(counts, "_part"))
    position = slot.bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_before") + position + 1)
        .drop("_part", "_slot", "_before", "_total")
    )


def number_within(
    df: DataFrame, group: list[str], order_by: list[Column | str], name: str = "row_no"
) -> DataFrame:
    """Number the rows of each group 1..m, for groups of any size."""
    numbered = number_rows(df, [*group, *order_by], "_global_no")
    starts = numbered.groupBy(*group).agg(F.min("_global_no").alias("_start"))
    keys = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    return (
        numbered.alias("a")
        .join(starts.alias("b"), keys)
        .select(
            *[F.col(f"a.{c}") for c in df.columns],
            (F.col("_global_no") - F.col("_start") + 1).alias(name),
        )
    )


def sample_hash(key_cols: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))


def hash_rank(
    df: DataFrame,
    key_cols: list[str],
    seed: int,
    name: str = "hash_rank",
    total: str = "hash_total",
) -> DataFrame:
    """Rank rows 1..N in a seeded pseudo-random order and add N.

    The order is that of ``md5(seed|key)``. Ranks are taken inside 4,096 hash slices, which a unique
    key fills evenly, and shifted by the rows in the slices before (at most 4,096 offsets).
    """
    hashed = df.withColumn("_hash", sample_hash(key_cols, seed)).withColumn(
        "_slice", F.substring("_hash", 1, _HEX_DIGITS)
    )
    counts = (
        df.select(F.substring(sample_hash(key_cols, seed), 1, _HEX_DIGITS).alias("_slice"))
        .groupBy("_slice")
        .agg(F.count("*").alias("_n"))
    )
    in_slice = Window.partitionBy("_slice").orderBy("_hash", *key_cols)
    return (
        hashed.join(F.broadcast(_offsets(counts, "_slice")), "_slice")
        .withColumn(name, F.row_number().over(in_slice) + F.col("_before"))
        .withColumnRenamed("_total", total)
        .drop("_slice", "_hash", "_before")
    )


def hash_first(df: DataFrame, key_cols: list[str], seed: int, wanted: Column) -> DataFrame:
    """The first ``wanted`` rows in seeded hash order; slices that lie beyond are never ranked."""
    hashed = df.withColumn("_hash", sample_hash(key_cols, seed)).withColumn(
        "_slice", F.substring("_hash", 1, _HEX_DIGITS)
    )
    counts = (
        df.select(F.substring(sample_hash(key_cols, seed), 1, _HEX_DIGITS).alias("_slice"))
        .groupBy("_slice")
        .agg(F.count("*").alias("_n"))
    )
    needed = _offsets(counts, "_slice").where(F.col("_before") < wanted)
    in_slice = Window.partitionBy("_slice").orderBy("_hash", *key_cols)
    return (
        hashed.join(F.broadcast(needed), "_slice")
        .withColumn("_rank", F.row_number().over(in_slice) + F.col("_before"))
        .where(F.col("_rank") <= wanted)
        .drop("_slice", "_hash", "_before", "_total", "_rank")
    )
