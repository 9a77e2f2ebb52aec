"""A listener's top tracks with their features, as a table and as printable lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.listener import feature_table
from cadenza.operators.numbering import number_within


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def report_line() -> Column:
    return F.concat(
        (F.col("pos") + 1).cast("string"),
        F.lit(". "),
        F.col("artist"),
        F.lit(" - "),
        F.col("name"),
        F.lit(" | energy: "),
        _shown("energy"),
        F.lit(", danceability: "),
        _shown("danceability"),
        F.lit(", tempo: "),
        _shown("tempo"),
    )


def tracks_with_features(tracks: DataFrame, records: DataFrame, features: list[str]) -> DataFrame:
    """Each listed track with the record whose address names its id; tracks without one are left out."""
    found = feature_table(records, features).withColumnRenamed("spotify_id", "track_id")
    return tracks.join(found, "track_id")


def top_tracks_report(tracks: DataFrame, records: DataFrame) -> DataFrame:
    """Listed tracks with a numbered line about each."""
    shown = ["energy", "danceability", "tempo"]
    return tracks_with_features(tracks, records, shown).withColumn("line", report_line())


def paired_by_position(
    tracks: DataFrame, records: DataFrame, within: list[str], tracks_by: list[str], records_by: list[str]
) -> DataFrame:
    """Pair the i-th track with the i-th record of the same list, in the order of either side's columns.

    Lists are zipped to the shorter one: both sides are numbered ``place`` = 1, 2, ... within ``within``, by a
    distributed sort, and rows without a partner are dropped. Lists with a missing name are never paired. For
    callers whose lists are known to be aligned; otherwise pair by id.
    """
    named = " AND ".join(f"`{c}` IS NOT NULL" for c in within)
    left = number_within(tracks.where(named), within, [F.col(c) for c in tracks_by], "place")
    right = number_within(records.where(named), within, [F.col(c) for c in records_by], "place")
    return left.join(right, [*within, "place"])
