"""From typed (title, artist) requests to catalogue tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import has_text
from cadenza.operators.clean import fill_missing, first_per_key
from cadenza.operators.numbering import number_within
from cadenza.session import materialize

LOCAL, EXTERNAL, NOT_FOUND = "local", "external", "not_found"


GRAM = 3


def _grams(text: str, size: Column) -> Column:
    """All distinct parts of ``text`` that have the given length, none if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    cut = F.array_distinct(F.transform(starts, lambda i: F.col(text).substr(i, size)))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def containing(words: DataFrame, texts: DataFrame, within: list[str]) -> DataFrame:
    """Pairs (``within``, word, text) where the text contains the word: an index of three-character parts.

    ``words`` has ``within`` and word, ``texts`` has ``within`` and text, both distinct. A text is listed under its
    distinct parts, a word looks only under its rarest one, and what it finds there is verified. Words of fewer
    characters look under themselves; parts of such sizes are listed only if a word needs them.
    """
    words = words.where("word IS NOT NULL")
    size = F.least(F.length("word"), F.lit(GRAM))
    sizes = [r[0] for r in words.select(size).distinct().collect()]  # 0 to GRAM, so at most four
    parts = F.array_distinct(F.flatten(F.array(*[_grams("text", F.lit(n)) for n in sorted(sizes)] or [F.array().cast("array<string>")])))
    index = texts.select(*within, "text", F.explode(parts).alias("gram"))
    listed = index.groupBy(*within, "gram").agg(F.count("*").alias("texts"))
    rarest = (
        words.select(*within, "word", F.explode(_grams("word", size)).alias("gram"))
        .join(listed, [*within, "gram"], "left")
        .groupBy(*within, "word")
        .agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("_rare"))
        .where("_rare.texts > 0")
        .select(*within, "word", F.col("_rare.gram").alias("gram"))
    )
    return (
        rarest.join(index, [*within, "gram"])
        .where(F.contains("text", F.col("word")))
        .select(*within, "word", "text")
    )


def first_matches(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Lowest track id whose title equals the request and whose artist text contains its artist.

    Containment is looked up in the artist texts of the same title. Requests and artist texts are made distinct
    first, so a title shared by very many rows costs one entry per distinct artist.
    """
    wanted = requests.select(F.lower("title").alias("title_key"), F.lower("artist").alias("word")).distinct()
    tracks = catalogue.groupBy(F.lower("name").alias("title_key"), F.lower("artists").alias("text")).agg(
        F.min("id").alias("track_id")
    )
    asked = tracks.join(wanted.select("title_key").distinct(), "title_key", "left_semi")
    found = (
        containing(wanted, asked.where("text IS NOT NULL").select("title_key", "text"), ["title_key"])
        .join(tracks, ["title_key", "text"])
        .groupBy("title_key", "word")
        .agg(F.min("track_id").alias("track_id"))
    )
    return (
        requests.withColumn("title_key", F.lower("title"))
        .withColumn("word", F.lower("artist"))
        .join(found, ["title_key", "word"])
        .select("request_id", "track_id")
    )


def search_catalogue(
    catalogue: DataFrame, title: str, artist: str, regex: bool = False
) -> DataFrame:
    """Tracks whose title and artist text contain the given words, ignoring case."""
    return catalogue.where(has_text("name", title, regex) & has_text("artists", artist, regex))


def list_matches(requests: DataFrame, catalogue: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Every track whose title and artist text contain those of the request, numbered 1..m by id.

    Titles are found through their rarest part in common with the requested word. The numbering is spread over
    sorted slices, so a word that fits very many tracks does not end up in one task. Requests of the same words
    share one numbered list, which meets them last; only ids that stand for several requests get a list of their own.
    ``only`` has request_id and pick, and leaves the matches of those numbers; all are numbered all the same.
    """
    asked = requests.select(
        F.lower("title").alias("word"), F.lower("artist").alias("artist_word"), "request_id"
    )
    ids = asked.groupBy("request_id").agg((F.count("*") == 1).alias("alone"))
    asked = asked.alias("a").join(ids.alias("b"), F.col("a.request_id").eqNullSafe(F.col("b.request_id")))
    alone = F.col("alone")
    menu = ["menu_word", "menu_artist", "menu_id", "alone"]
    asked = asked.select(
        "a.*", "alone", F.when(alone, F.col("word")).alias("menu_word"),
        F.when(alone, F.col("artist_word")).alias("menu_artist"), F.when(~alone, F.col("a.request_id")).alias("menu_id"),
    )
    asked = materialize(asked.where("word IS NOT NULL AND artist_word IS NOT NULL"), "menu-requests")
    titles = catalogue.select(F.lower("name").alias("text")).where("text IS NOT NULL").distinct()
    hits = containing(asked.select("word").distinct(), titles, []).withColumnRenamed("text", "title_key")
    tracks = catalogue.select(
        F.col("id").alias("track_id"), "name", "artists", F.lower("name").alias("title_key")
    )
    entries = asked.select("word", "artist_word", *menu)
    entries = entries.where("alone").distinct().unionByName(entries.where("NOT alone"))
    listed = (
        entries.join(hits, "word")
        .join(tracks, "title_key")
        .where(F.contains(F.lower("artists"), F.col("artist_word")))
        .select(*menu, "track_id", "name", "artists")
    )
    numbered = materialize(number_within(listed, menu, ["track_id"], "match_no"), "menus")
    owners = asked.select("request_id", *menu).distinct()
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"m.{c}")) for c in menu]
    if only is not None:
        picks = only.select("request_id", F.col("pick").alias("match_no")).distinct()
        owners = owners.join(picks, "request_id")
        same.append(F.col("o.match_no") == F.col("m.match_no"))
    return owners.alias("o").join(numbered.alias("m"), same).select(
        "o.request_id", "m.track_id", "m.name", "m.artists", "m.match_no"
    )


def pick_match(matches: DataFrame, picks: DataFrame) -> DataFrame:
    """The match each caller chose by number; ``in_range`` is false where no such number was listed."""
    chosen = picks.select("request_id", F.col("pick").alias("match_no"))
    return chosen.join(matches, ["request_id", "match_no"], "left").withColumn(
        "in_range", F.col("track_id").isNotNull()
    )


def resolve(
    requests: DataFrame,
    catalogue: DataFrame,
    features: list[str],
    search_hits: DataFrame | None = None,
    external_features: DataFrame | None = None,
) -> DataFrame:
    """Features for each request: from the catalogue, else from staged search and feature payloads.

    ``search_hits`` has request_id and track_id, ``external_features`` has track_id and the features.
    Missing values in an external record count as 0. Every request is returned, with its ``status``.
    """
    tracks = catalogue.select(F.col("id").alias("track_id"), *features)
    local = first_matches(requests, catalogue).join(tracks, "track_id")
    out = requests.join(local, "request_id", "left").withColumn(
        "status", F.when(F.col("track_id").isNotNull(), LOCAL)
    )
    if search_hits is None or external_features is None:
        return out.withColumn("status", F.coalesce("status", F.lit(NOT_FOUND)))
    found = fill_missing(
        first_per_key(external_features.select("track_id", *features), ["track_id"]), features
    )
    open_requests = out.where(F.col("status").isNull()).select("request_id")
    external = (
        search_hits.select("request_id", "track_id")
        .join(open_requests, "request_id", "left_semi")
        .join(found, "track_id")
        .select(
            "request_id",
            F.col("track_id").alias("_track_id"),
            *[F.col(f).alias(f"_{f}") for f in features],
        )
    )
    merged = out.join(external, "request_id", "left")
    status = F.coalesce(
        "status", F.when(F.col("_track_id").isNotNull(), EXTERNAL).otherwise(NOT_FOUND)
    )
    return merged.select(
        *requests.columns,
        *[F.coalesce(c, f"_{c}").alias(c) for c in ["track_id", *features]],
        status.alias("status"),
    )
