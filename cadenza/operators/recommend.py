"""The two feature-space recommenders, over request tables that already carry features."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.text import by_line, inner_text
from cadenza.operators.neighbours import nearest, with_names
from cadenza.operators.scaling import Scaler


def request_from(
    spark: SparkSession, song: Row | Mapping | DataFrame | list, features: list[str]
) -> DataFrame:
    """One query song, however it is given, as a one-row request table.

    A table contributes its first row. A plain list must have one value per feature.
    """
    if isinstance(song, DataFrame):
        values = song.select(*[F.col(f).cast("double").alias(f) for f in features]).limit(1)
        return values.select(
            F.lit(0).cast("long").alias("request_id"),
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("string").alias("track_id"),
            *features,
        )
    if isinstance(song, Row):
        song = song.asDict()
    if isinstance(song, Mapping):
        numbers: Iterable = [song[f] for f in features]
    elif isinstance(song, list):
        if len(song) != len(features):
            raise ValueError(f"expected {len(features)} feature values, got {len(song)}")
        numbers = song
    else:
        raise TypeError(f"a song cannot be given as {type(song).__name__}")
    schema = "request_id long, title string, track_id string, " + ", ".join(
        f"{f} double" for f in features
    )
    return spark.createDataFrame([(0, None, None, *[float(x) for x in numbers])], schema)


def knn_recommendations(
    requests: DataFrame,
    catalogue: DataFrame,
    features: list[str],
    n: int = 10,
    exclude_self: bool = False,
    scaler: Scaler | None = None,
    tidy: bool = True,
) -> DataFrame:
    """``n`` nearest tracks by Euclidean distance. The song itself counts unless ``exclude_self``."""
    hits = nearest(
        requests, catalogue, features, n, "euclidean", exclude_self=exclude_self, scaler=scaler
    )
    return with_names(hits, catalogue).withColumn("line", by_line("name", "artists", tidy))


def cosine_recommendations(
    requests: DataFrame,
    catalogue: DataFrame,
    features: list[str],
    n: int = 3,
    exclude_same_title: bool = True,
    exclude_self: bool = False,
    scaler: Scaler | None = None,
) -> DataFrame:
    """``n`` most cosine-similar tracks, by default other than tracks of the same title."""
    hits = nearest(
        requests,
        catalogue,
        features,
        n,
        "cosine",
        exclude_same_title=exclude_same_title,
        exclude_self=exclude_self,
        scaler=scaler,
    )
    line = F.concat(F.col("name"), F.lit(" by "), inner_text("artists"))
    return with_names(hits, catalogue).withColumn("line", line)


def distinct_songs(recommendations: DataFrame) -> DataFrame:
    """Each recommended track once over all requests, at its best rank."""
    best = F.min(F.struct("rank", "request_id"))
    return (
        recommendations.groupBy("track_id", "name", "artists")
        .agg(best.alias("_best"))
        .select("track_id", "name", "artists", "_best.rank", "_best.request_id")
    )
