"""CSV and Parquet inputs and outputs with declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.clean import tidy_headers
from cadenza.schema import (
    LISTENS,
    MUSIC_INFO,
    SCROBBLES,
    SCROBBLES_MBID,
    TRACKS,
    require_columns,
)
from cadenza.sources.landing import publish, published


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keep_others: bool = False,
    any_case_header: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV file with a header. Columns are found by name and cast to the declared types.

    No value is scanned to infer types. Other columns are dropped, or kept as text on request. A value
    that does not fit its type becomes NULL. ``multi_line`` allows line breaks inside quotes, at the
    price of one task per file.
    """
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    if any_case_header:
        raw = tidy_headers(raw)
    names = [f.name for f in schema.fields]
    require_columns(raw, names, path)
    typed = [
        F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name)
        if not isinstance(f.dataType, (T.IntegerType, T.LongType))
        else F.col(f"`{f.name}`").try_cast("double").cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    others = [F.col(f"`{c}`") for c in raw.columns if keep_others and c not in names]
    return raw.select(*typed, *others)


def read_tracks(spark: SparkSession, path: str, keep_others: bool = True) -> DataFrame:
    """Track catalogue. Other columns stay, because an incomplete row is one with any gap at all."""
    return read_csv(spark, path, TRACKS, keep_others)


def read_music_info(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MUSIC_INFO)


def read_listens(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LISTENS)


def read_scrobbles(spark: SparkSession, path: str) -> DataFrame:
    """Personal play export; header case and blanks vary between exporters."""
    return read_csv(spark, path, SCROBBLES, any_case_header=True)


def read_scrobbles_mbid(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SCROBBLES_MBID, keep_others=True)


def land(df: DataFrame, path: str) -> DataFrame:
    """Store a table as Parquet and continue from it: written beside, verified, then published."""
    return publish(df, path)


def write_track_metadata(df: DataFrame, path: str) -> None:
    require_columns(df, ["track_id", "name", "artist"], "track metadata")
    publish(df.select("track_id", "name", "artist"), path)


def read_track_metadata(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(published(spark, path), ["track_id", "name", "artist"], path)


def write_interactions(df: DataFrame, path: str) -> None:
    require_columns(df, ["track_id", "user_id", "playcount"], "interactions")
    publish(df.select("track_id", "user_id", "playcount"), path)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(published(spark, path), ["track_id", "user_id", "playcount"], path)


def write_interactions_table(
    df: DataFrame, name: str, buckets: int, mode: str = "errorifexists", path: str | None = None
) -> None:
    """Bucketed and sorted by user, so that joins and sums over listeners need no shuffle of this side.

    The files go to ``path``, or to the warehouse without one.
    """
    require_columns(df, ["track_id", "user_id", "playcount"], "interactions")
    place = {"path": path} if path else {}
    (
        df.select("track_id", "user_id", "playcount")
        .repartition(buckets, "user_id")  # the same hash as the buckets': one file each
        .write.mode(mode)
        .options(**place)
        .bucketBy(buckets, "user_id")
        .sortBy("user_id")
        .saveAsTable(name)
    )


def read_interactions_table(spark: SparkSession, name: str) -> DataFrame:
    return require_columns(spark.table(name), ["track_id", "user_id", "playcount"], name)


def write_history(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Listener history with features, as CSV with a header."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_recommendations(df: DataFrame, path: str) -> None:
    columns = ["request_id", "model", "rank", "track_id", "name", "artist", "score", "line"]
    require_columns(df, columns, "recommendations")
    publish(df.select(*columns), path)
