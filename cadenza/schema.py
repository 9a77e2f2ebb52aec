"""Explicit schemas and feature sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Feature names and their order in the three model families.
FEATURES_4 = ["danceability", "acousticness", "instrumentalness", "loudness"]
FEATURES_9 = [
    "energy",
    "danceability",
    "tempo",
    "acousticness",
    "instrumentalness",
    "liveness",
    "loudness",
    "speechiness",
    "valence",
]
FEATURES_11 = [
    "danceability",
    "energy",
    "tempo",
    "valence",
    "acousticness",
    "instrumentalness",
    "liveness",
    "speechiness",
    "loudness",
    "key",
    "mode",
]

_INTEGER_FEATURES = {"key", "mode"}


def feature_fields(names: list[str]) -> list[T.StructField]:
    return [
        T.StructField(name, T.IntegerType() if name in _INTEGER_FEATURES else T.DoubleType())
        for name in names
    ]


TRACKS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("artists", T.StringType()),
        *feature_fields(FEATURES_11),
    ]
)

MUSIC_INFO = T.StructType(
    [
        T.StructField("track_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("artist", T.StringType()),
    ]
)

LISTENS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("track_id", T.StringType()),
        T.StructField("playcount", T.LongType()),
    ]
)

SCROBBLES = T.StructType(
    [T.StructField("artist", T.StringType()), T.StructField("track", T.StringType())]
)

SCROBBLES_MBID = T.StructType([T.StructField("track_mbid", T.StringType())])

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("artist", T.StringType()),
    ]
)

FEATURE_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("isrc", T.StringType()),
        *feature_fields(FEATURES_11),
    ]
)

FEATURE_PAYLOAD = T.StructType([T.StructField("content", T.ArrayType(FEATURE_RECORD))])

_ARTIST_REF = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("name", T.StringType())]
)
_TRACK_REF = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("artists", T.ArrayType(_ARTIST_REF)),
    ]
)

TOP_TRACKS_PAYLOAD = T.StructType([T.StructField("items", T.ArrayType(_TRACK_REF))])

SEARCH_PAYLOAD = T.StructType(
    [
        T.StructField(
            "tracks", T.StructType([T.StructField("items", T.ArrayType(_TRACK_REF))])
        )
    ]
)


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    """Fail early, by name, when a table lacks a column an operator needs."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df
