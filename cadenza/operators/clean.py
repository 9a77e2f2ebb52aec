"""Cleaning, de-duplication and grouping steps shared by all models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import first_artist, strip
from cadenza.operators.numbering import number_rows
from cadenza.schema import require_columns


def first_per_key(df: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Keep one row per key: the first by ``order_by``, then by every other column.

    The row limit is applied before the shuffle too, so a key with very many rows stays cheap.
    """
    order = list(order_by or [])
    order += [c for c in df.columns if c not in keys and c not in order]
    pick = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])
    return (
        df.withColumn("_nth", F.row_number().over(pick)).where(F.col("_nth") == 1).drop("_nth")
    )


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with NULL or NaN in any of ``columns`` (default: any column at all)."""
    return df.na.drop(subset=columns)


def fill_missing(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    return df.na.fill(value, subset=columns)


def clean_catalogue(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per track id, complete rows only."""
    return drop_incomplete(first_per_key(df, ["id"], order_by))


def tidy_headers(df: DataFrame) -> DataFrame:
    """Trim and lower every column name."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def songs_by_first_artist(catalogue: DataFrame, features: list[str]) -> DataFrame:
    """Catalogue in listener form: id, artist (the first one), track and the features."""
    require_columns(catalogue, ["id", "name", "artists", *features], "catalogue")
    return catalogue.select(
        "id",
        strip(first_artist("artists")).alias("artist"),
        strip("name").alias("track"),
        *features,
    )


def encode_category(df: DataFrame, column: str, code: str | None = None) -> DataFrame:
    """Add 0-based codes in sorted order of the values; missing values get -1.

    The dictionary is a distributed table: no value list is ever held by the driver.
    """
    code = code or f"{column}_code"
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = number_rows(values, [column], code).withColumn(code, F.col(code) - 1)
    return df.join(codes, column, "left").withColumn(code, F.coalesce(code, F.lit(-1)))


def keep_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``members``."""
    return df.join(members.select(key), key, "left_semi")


def count_per(df: DataFrame, key: str, counted: str | None = None, name: str = "count") -> DataFrame:
    """Rows per non-missing key, or non-missing ``counted`` values per key."""
    what = F.count("*") if counted is None else F.count(counted)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(what.alias(name))


def with_group_count(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Put the size of its group on every row (partial counts, then a join back)."""
    return df.join(count_per(df, key, name=name), key, "left")


def one_row_with_count(
    df: DataFrame, key: str, order_by: list[str], name: str = "count"
) -> DataFrame:
    """One row per non-missing key, the first by ``order_by``, with the number of rows it stands for.

    A single aggregation with partial results, whatever the size of a group.
    """
    others = [c for c in df.columns if c != key]
    leading = order_by + [c for c in others if c not in order_by]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias(name), F.min(F.struct(*leading)).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in others], name)
    )


def lookup(keys: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Details of each key: an inner join with one details row per key."""
    return keys.join(first_per_key(details, [key]), key)


def missing_keys(keys: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Keys that ``lookup`` would not find."""
    return keys.select(key).distinct().join(details.select(key), key, "left_anti")


def difference(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` without a partner in ``other``; duplicates and columns of ``df`` are kept."""
    return df.join(other.select(*on), on, "left_anti")


def stacked(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Union by column name; a column only one side has is NULL on the other."""
    return top.unionByName(bottom, allowMissingColumns=True)


def weighted(df: DataFrame, columns: list[str], weight: str) -> list[Column]:
    """Each column multiplied by the weight column."""
    return [F.col(c) * F.col(weight) for c in columns]
