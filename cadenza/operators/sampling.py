"""Seeded sampling and splitting with exact sizes, reproducible on any cluster layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.clean import drop_incomplete, one_row_with_count
from cadenza.operators.numbering import hash_first, hash_rank


def sample_exactly(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows drawn uniformly without replacement, in the order of a seeded hash of the key."""
    return hash_first(df, key, seed, F.lit(n))


def sample_negatives(unheard: DataFrame, positives: DataFrame, key: list[str], seed: int) -> DataFrame:
    """As many unheard rows as there are positive ones."""
    wanted = positives.agg(F.count("*").alias("n")).scalar()
    return hash_first(unheard, key, seed, wanted)


def sample_fraction(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """About ``fraction`` of the rows: those whose seeded hash lies below it, on any layout the same.

    The hash is that of the row's values and, among equal rows, of its number: equal rows are counted first,
    then each copy is drawn on its own.
    """
    values = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_copy").cast("string"), values))
    share = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return copies.where(share < fraction).select(*df.columns)


def split_exactly(df: DataFrame, key: list[str], test_share: float, seed: int) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(test_share * N)`` rows are true."""
    ranked = hash_rank(df, key, seed, "_rank", "_total")
    size = F.ceil(F.lit(test_share) * F.col("_total"))
    return ranked.withColumn("is_test", F.col("_rank") <= size).drop("_rank", "_total")


def separate_plays(
    plays: DataFrame,
    key: str,
    order_by: list[str],
    test_share: float = 0.2,
    seed: int = 64,
) -> DataFrame:
    """Plays with a key, one row per key with its listen count, split into train and test."""
    songs = one_row_with_count(drop_incomplete(plays, [key]), key, order_by)
    return split_exactly(songs, [key], test_share, seed)
