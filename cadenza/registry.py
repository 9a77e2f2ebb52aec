"""Every operator as a named query over the star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import text
from cadenza.functions.fuzzy import fuzzy_ratio
from cadenza.operators import (
    clean,
    clusters,
    collaborative,
    interactions,
    listener,
    neighbours,
    numbering,
    recommend,
    resolve,
    sampling,
    scaling,
)
from cadenza.plans import reports
from cadenza.plans.ensemble import ensemble_recommendations
from cadenza.schema import (
    FEATURE_PAYLOAD,
    FEATURES_4,
    FEATURES_9,
    FEATURES_11,
    SEARCH_PAYLOAD,
    TOP_TRACKS_PAYLOAD,
)
from cadenza.session import materialize, shared_dir
from cadenza.sources import files, landing, payloads
from cadenza.sources import star_tables as star

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Customers here have at most about 105 distinct tracks, so the usual limit of 100 would keep almost none.
TRACK_LIMIT = 40


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _rounded(c: str | Column, name: str) -> Column:
    """Six decimals, and never a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


# ---- sources and projections -------------------------------------------------------------------


@query
def catalogue_scan(spark: SparkSession, sf: str) -> DataFrame:
    return star.tracks(spark, sf).select("id", "name", "artists", *[_rounded(f, f) for f in FEATURES_11])


@query
def feature_set_4(spark: SparkSession, sf: str) -> DataFrame:
    return star.tracks(spark, sf).select("id", *[_rounded(f, f) for f in FEATURES_4])


@query
def feature_set_9(spark: SparkSession, sf: str) -> DataFrame:
    return star.tracks(spark, sf).select("id", *[_rounded(f, f) for f in FEATURES_9])


@query
def songs_by_first_artist(spark: SparkSession, sf: str) -> DataFrame:
    songs = clean.songs_by_first_artist(star.tracks(spark, sf), FEATURES_11)
    return songs.select("id", "artist", "track", *[_rounded(f, f) for f in FEATURES_11])


@query
def tidy_headers(spark: SparkSession, sf: str) -> DataFrame:
    messy = star.scrobbles(spark, sf).toDF(" Artist", "TRACK ")
    return clean.tidy_headers(messy).groupBy("artist", "track").agg(F.count("*").alias("plays"))


@query
def category_codes(spark: SparkSession, sf: str) -> DataFrame:
    plays = star.listens(spark, sf).select("user_id").distinct()
    names = plays.withColumn("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return clean.encode_category(names, "user_id")


@query
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    def size(df: DataFrame, name: str) -> DataFrame:
        n = F.count("*")
        return df.agg(n.alias("n_rows"), (n == 0).alias("is_empty")).withColumn("name", F.lit(name))

    nothing = star.tracks(spark, sf).where(F.col("id") < 0)
    return (
        size(star.tracks(spark, sf), "tracks")
        .unionByName(size(star.listens(spark, sf), "listens"))
        .unionByName(size(nothing, "nothing"))
    )


# ---- files there and back -----------------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, name: str) -> str:
    """The folder of a published CSV table, as an export would deliver it."""
    place = _place(df.sparkSession, name)
    landing.publish(df, place, "csv", header="true", escape='"')
    return landing.published_folder(df.sparkSession, place)


@query
def catalogue_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue written as CSV, published, and read by name and declared type."""
    back = files.read_tracks(spark, _csv(star.tracks(spark, sf), "tracks"), keep_others=False)
    return back.select(F.col("id").cast("long").alias("id"), "name", "artists", *[_rounded(f, f) for f in FEATURES_11])


@query
def music_csv(spark: SparkSession, sf: str) -> DataFrame:
    back = files.read_music_info(spark, _csv(star.music_info(spark, sf), "music"))
    return back.select(F.col("track_id").cast("long").alias("track_id"), "name", "artist")


@query
def listens_csv(spark: SparkSession, sf: str) -> DataFrame:
    plays = star.listens(spark, sf).select("user_id", "track_id", F.col("playcount").cast("long").alias("playcount"))
    back = files.read_listens(spark, _csv(plays, "listens"))
    return back.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("playcount").alias("plays"))


@query
def scrobbles_csv(spark: SparkSession, sf: str) -> DataFrame:
    messy = star.scrobbles(spark, sf).toDF(" Artist", "TRACK ")
    return listener.play_counts(files.read_scrobbles(spark, _csv(messy, "scrobbles")))


@query
def track_metadata_landed(spark: SparkSession, sf: str) -> DataFrame:
    place = _place(spark, "metadata")
    files.write_track_metadata(interactions.track_metadata(_interactions(spark, sf), star.music_info(spark, sf)), place)
    return files.read_track_metadata(spark, place)


@query
def interactions_landed(spark: SparkSession, sf: str) -> DataFrame:
    place = _place(spark, "matrix")
    files.write_interactions(_interactions(spark, sf), place)
    return files.read_interactions(spark, place)


@query
def listeners_per_track_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix as a table bucketed by user, joined on users without moving it: tracks per listener beside each row."""
    name = f"matrix_{uuid.uuid4().hex}"
    files.write_interactions_table(_interactions(spark, sf), name, 8, path=_place(spark, name))
    matrix = files.read_interactions_table(spark, name)
    return interactions.with_listener_reach(matrix).groupBy("track_id").agg(
        F.count("*").alias("listeners"), F.sum("reach").alias("reached")
    )


@query
def history_csv(spark: SparkSession, sf: str) -> DataFrame:
    place = _place(spark, "history")
    files.write_history(_history(spark, sf), place)
    back = files.read_csv(spark, place, T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES_11]), keep_others=True)
    return back.select("artist", "track", F.col("count").cast("long").alias("count"), "spotify_id", *[_rounded(f, f) for f in FEATURES_11])


@query
def recommendations_landed(spark: SparkSession, sf: str) -> DataFrame:
    tracks = star.tracks(spark, sf)
    hits = recommend.cosine_recommendations(_self_requests(tracks, FEATURES_4), tracks, FEATURES_4, 3)
    place = _place(spark, "recommendations")
    files.write_recommendations(hits.withColumn("model", F.lit("cosine")).withColumnRenamed("artists", "artist"), place)
    back = landing.published(spark, place)
    return back.withColumn("score", _rounded("score", "score"))


# ---- cleaning, de-duplication, joins ----------------------------------------------------------


@query
def catalogue_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_catalogue(star.raw_catalogue(spark, sf), ["row_a", "row_b"])


@query
def listens_dedup(spark: SparkSession, sf: str) -> DataFrame:
    plays = clean.first_per_key(star.listens(spark, sf), ["user_id", "track_id"], star.LISTEN_ORDER)
    return plays.select("user_id", "track_id", "playcount")


@query
def plays_with_key(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_incomplete(star.scrobbles_mbid(spark, sf), ["track_mbid"])


@query
def plays_with_listen_count(spark: SparkSession, sf: str) -> DataFrame:
    return clean.with_group_count(star.scrobbles_mbid(spark, sf), "track_mbid", "listens")


@query
def plays_one_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return clean.one_row_with_count(star.scrobbles_mbid(spark, sf), "track_mbid", ["event_id"])


@query
def plays_separated(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.separate_plays(star.scrobbles_mbid(spark, sf), "track_mbid", ["event_id"])


@query
def metadata_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = star.listens(spark, sf).select("track_id").distinct()
    return clean.lookup(keys, star.music_info(spark, sf), "track_id")


@query
def metadata_missing(spark: SparkSession, sf: str) -> DataFrame:
    keys = star.listens(spark, sf).select(F.col("track_id").alias("id"))
    return clean.missing_keys(keys, star.tracks(spark, sf), "id")


@query
def heard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return star.scrobbles(spark, sf).select("artist", "track").distinct()


@query
def listens_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    known = star.tracks(spark, sf).select(F.col("id").alias("track_id"), "name", "artists")
    joined = star.listens(spark, sf).join(known, "track_id", "left")
    return joined.select("user_id", "track_id", "playcount", "name", "artists")


@query
def missing_values(spark: SparkSession, sf: str) -> DataFrame:
    quantity = F.when(F.col("l_linenumber") > 1, F.col("l_quantity"))
    odd = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(quantity)
    rows = star.table(spark, sf, "lineitem").select("l_returnflag", odd.alias("tempo"))
    filled = clean.fill_missing(rows.withColumn("gap", text.is_missing("tempo")), ["tempo"])
    return filled.groupBy("l_returnflag", "gap").agg(
        F.count("*").alias("n"), F.sum("tempo").alias("tempo_sum")
    )


# ---- listening history ------------------------------------------------------------------------


@query
def user_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clean.count_per(star.listens(spark, sf), "user_id", name="n")


@query
def active_users(spark: SparkSession, sf: str) -> DataFrame:
    return interactions.active_users(star.listens(spark, sf))


@query
def broad_users(spark: SparkSession, sf: str) -> DataFrame:
    plays = clean.first_per_key(star.listens(spark, sf), ["user_id", "track_id"], star.LISTEN_ORDER)
    return interactions.broad_users(plays, TRACK_LIMIT)


@query
def listens_of_active_users(spark: SparkSession, sf: str) -> DataFrame:
    plays = star.listens(spark, sf)
    return clean.keep_members(plays, interactions.active_users(plays), "user_id").select(
        "user_id", "track_id", "playcount"
    )


def _interactions(spark: SparkSession, sf: str) -> DataFrame:
    return interactions.build_interactions(
        star.listens(spark, sf), star.LISTEN_ORDER, min_tracks_exclusive=TRACK_LIMIT
    )


@query
def interaction_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _interactions(spark, sf)


@query
def mean_playcounts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        star.listens(spark, sf)
        .groupBy("track_id", "user_id")
        .agg(_rounded(F.avg("playcount"), "playcount"))
    )


@query
def track_norms(spark: SparkSession, sf: str) -> DataFrame:
    return interactions.track_norms(_interactions(spark, sf)).select(
        "track_id", _rounded("norm", "norm"), "listeners"
    )


@query
def track_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return interactions.track_metadata(_interactions(spark, sf), star.music_info(spark, sf))


# ---- text ----------------------------------------------------------------------------------------


@query
def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit(" \t"), F.col("p_name"), F.lit("\n"))
    pair = F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))
    rows = star.table(spark, sf, "part").withColumn("padded", padded).withColumn("pair", pair)
    return rows.select(
        "p_partkey",
        text.capitalise("p_type").alias("capitalised"),
        text.strip("padded").alias("stripped"),
        text.bare_artists("pair").alias("bare"),
        text.artists_line("pair").alias("artists_tidy"),
        text.artists_line("pair", tidy=False).alias("artists_exact"),
        text.by_line("padded", "pair").alias("line"),
        text.by_line("padded", "pair", tidy=False, trimmed=False).alias("line_untrimmed"),
        text.inner_text("pair").alias("inside"),
        text.dash_line("p_name", "p_brand").alias("dashed"),
        text.search_key("p_name", "p_brand").alias("key_by"),
        text.search_key("p_name", "p_brand", "dash").alias("key_dash"),
        text.search_key("p_name", None, "title").alias("key_title"),
        text.first_artist("pair").alias("first_artist"),
        F.size(text.parse_list("pair")).alias("n_artists"),
    )


@query
def cleaned_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = star.table(spark, sf, "documents")
    body = text.cleaned("text")
    return docs.select("doc_id", F.length(body).alias("n"), F.md5(body).alias("digest"))


@query
def fuzzy_scores(spark: SparkSession, sf: str) -> DataFrame:
    asked = star.misspelt_requests(spark, sf)
    info = star.music_info(spark, sf).withColumnRenamed("track_id", "request_id")
    return asked.join(info.withColumnRenamed("artist", "brand"), "request_id").select(
        "request_id", fuzzy_ratio(text.cleaned("title"), text.cleaned("name")).alias("score")
    )


@query
def ids_from_addresses(spark: SparkSession, sf: str) -> DataFrame:
    href = F.regexp_replace("url", "/(en|de)/", "/track/")
    return star.table(spark, sf, "pages").select(
        "page_id", text.track_id_from_href(href).alias("track_id")
    )


@query
def payload_fields(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.from_json("props", "k int, missing string")
    return star.table(spark, sf, "events").select(
        "event_id",
        doc.getField("k").alias("k"),
        F.coalesce(doc.getField("missing"), F.lit("none")).alias("missing"),
    )


# ---- request resolution ------------------------------------------------------------------------


@query
def request_matches(spark: SparkSession, sf: str) -> DataFrame:
    asked = star.requests(spark, sf)
    found = resolve.first_matches(asked, star.tracks(spark, sf))
    status = F.when(F.col("track_id").isNull(), resolve.NOT_FOUND).otherwise(resolve.LOCAL)
    return asked.join(found, "request_id", "left").select(
        "request_id", "track_id", status.alias("status")
    )


@query
def catalogue_search(spark: SparkSession, sf: str) -> DataFrame:
    hits = resolve.search_catalogue(star.tracks(spark, sf), "RING", "brand#1")
    return hits.select("id", "name", "artists")


@query
def catalogue_search_regex(spark: SparkSession, sf: str) -> DataFrame:
    hits = resolve.search_catalogue(star.tracks(spark, sf), "^(old|new) ", "#1[0-3]'", regex=True)
    return hits.select("id", "name", "artists")


@query
def match_menu(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.list_matches(star.requests(spark, sf), star.tracks(spark, sf))


@query
def match_picks(spark: SparkSession, sf: str) -> DataFrame:
    asked = star.requests(spark, sf)
    picks = asked.select("request_id", F.lit(2).cast("long").alias("pick"))
    menu = resolve.list_matches(asked, star.tracks(spark, sf), only=picks)
    return resolve.pick_match(menu, picks).select("request_id", "match_no", "track_id", "in_range")


def _search_hits(spark: SparkSession, sf: str) -> DataFrame:
    answers = payloads.parse_json(star.search_payloads(spark, sf), "body", SEARCH_PAYLOAD)
    return payloads.search_hits(answers)


def _external_features(spark: SparkSession, sf: str) -> DataFrame:
    answers = payloads.parse_json(star.external_payloads(spark, sf), "body", FEATURE_PAYLOAD)
    return payloads.feature_records(answers).withColumn("track_id", text.track_id_from_href("href"))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    hits = _search_hits(spark, sf).withColumn("track_id", F.col("track_id").cast("long"))
    records = _external_features(spark, sf).withColumn("track_id", F.col("track_id").cast("long"))
    return resolve.resolve(star.requests(spark, sf), star.tracks(spark, sf), FEATURES_4, hits, records)


@query
def resolved_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select(
        "request_id", "title", "artist", "status", "track_id", *[_rounded(f, f) for f in FEATURES_4]
    )


@query
def fuzzy_matches(spark: SparkSession, sf: str) -> DataFrame:
    return collaborative.match_seeds(star.misspelt_requests(spark, sf), star.music_info(spark, sf))


@query
def fuzzy_matches_by_title(spark: SparkSession, sf: str) -> DataFrame:
    return collaborative.match_seeds(
        star.misspelt_requests(spark, sf), star.music_info(spark, sf), "title"
    )


@query
def fuzzy_matches_weak(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that resemble no title: customer names and segments against song keys."""
    asked = star.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_mktsegment").alias("title"),
        F.col("c_name").alias("artist"),
    )
    return collaborative.match_seeds(asked, star.music_info(spark, sf))


# ---- feature-space models ----------------------------------------------------------------------


@query
def scaling_statistics(spark: SparkSession, sf: str) -> DataFrame:
    stats = scaling.scaling_statistics(star.tracks(spark, sf), FEATURES_11)
    return stats.select(*[_rounded(c, c) for c in stats.columns])


@query
def standardised_features(spark: SparkSession, sf: str) -> DataFrame:
    tracks = star.tracks(spark, sf).withColumn("flat", F.lit(3.5))
    scaled = scaling.fit_scaler(tracks, [*FEATURES_9, "flat"]).transform(tracks)
    return scaled.select("id", *[_rounded(f, f) for f in [*FEATURES_9, "flat"]])


def _self_requests(tracks: DataFrame, features: list[str]) -> DataFrame:
    return tracks.select(
        F.col("id").alias("request_id"), F.col("name").alias("title"), F.col("id").alias("track_id"), *features
    )


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select(
        "request_id", "rank", "track_id", "name", "artists", _rounded("score", "score"), "line"
    )


@query
def knn_tracks(spark: SparkSession, sf: str) -> DataFrame:
    tracks = star.tracks(spark, sf)
    return _shown(
        recommend.knn_recommendations(_self_requests(tracks, FEATURES_4), tracks, FEATURES_4, 10)
    )


@query
def knn_tracks_other(spark: SparkSession, sf: str) -> DataFrame:
    tracks = star.tracks(spark, sf)
    hits = recommend.knn_recommendations(
        _self_requests(tracks, FEATURES_4), tracks, FEATURES_4, 10, exclude_self=True
    )
    return _shown(hits)


@query
def cosine_tracks(spark: SparkSession, sf: str) -> DataFrame:
    tracks = star.tracks(spark, sf)
    return _shown(
        recommend.cosine_recommendations(_self_requests(tracks, FEATURES_4), tracks, FEATURES_4, 3)
    )


@query
def knn_one_song(spark: SparkSession, sf: str) -> DataFrame:
    """One song given as a table row, against the whole catalogue."""
    tracks = star.tracks(spark, sf)
    song = tracks.orderBy("id").limit(1)
    return _shown(
        recommend.knn_recommendations(recommend.request_from(spark, song, FEATURES_4), tracks, FEATURES_4)
    )


@query
def first_three(spark: SparkSession, sf: str) -> DataFrame:
    tracks = star.tracks(spark, sf)
    hits = neighbours.nearest(_self_requests(tracks, FEATURES_4), tracks, FEATURES_4, 10)
    return hits.where(F.col("rank") <= 3).select(
        "request_id", "rank", "track_id", _rounded("score", "score")
    )


def _top_tracks(spark: SparkSession, sf: str) -> DataFrame:
    answers = payloads.parse_json(star.top_track_payloads(spark, sf), "body", TOP_TRACKS_PAYLOAD)
    return payloads.top_tracks(answers)


def _feature_records(spark: SparkSession, sf: str) -> DataFrame:
    answers = payloads.parse_json(star.feature_payloads(spark, sf), "body", FEATURE_PAYLOAD)
    return payloads.feature_records(answers)


def _top_track_requests(spark: SparkSession, sf: str, features: list[str]) -> DataFrame:
    found = reports.tracks_with_features(_top_tracks(spark, sf), _feature_records(spark, sf), features)
    return clean.fill_missing(found, features).select(
        (F.col("user_id") * 100 + F.col("pos")).alias("request_id"),
        F.col("name").alias("title"),
        F.col("track_id").cast("long").alias("track_id"),
        *features,
    )


@query
def batch_cosine_top_tracks(spark: SparkSession, sf: str) -> DataFrame:
    asked = _top_track_requests(spark, sf, FEATURES_9)
    hits = recommend.cosine_recommendations(
        asked, star.tracks(spark, sf), FEATURES_9, 10, exclude_same_title=False
    )
    return hits.select("request_id", "rank", "track_id", "name", "artists", _rounded("score", "score"))


@query
def batch_knn_top_tracks(spark: SparkSession, sf: str) -> DataFrame:
    asked = _top_track_requests(spark, sf, FEATURES_4)
    return _shown(recommend.knn_recommendations(asked, star.tracks(spark, sf), FEATURES_4, 10))


@query
def batch_knn_distinct_songs(spark: SparkSession, sf: str) -> DataFrame:
    asked = _top_track_requests(spark, sf, FEATURES_4)
    hits = recommend.knn_recommendations(asked, star.tracks(spark, sf), FEATURES_4, 10)
    return recommend.distinct_songs(hits)


# ---- payloads ----------------------------------------------------------------------------------


@query
def feature_payload_rows(spark: SparkSession, sf: str) -> DataFrame:
    table = listener.feature_table(_feature_records(spark, sf), FEATURES_11)
    return table.select("spotify_id", *[_rounded(f, f) for f in FEATURES_11])


@query
def top_track_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _top_tracks(spark, sf)


@query
def search_payload_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _search_hits(spark, sf)


def _staged_searches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Search answers staged by request; those of every seventh request were cut off on the way."""
    answers = star.search_payloads(spark, sf)
    cut = F.when(F.col("request_id") % 7 == 0, F.substring("body", 1, 9)).otherwise(F.col("body"))
    place = _place(spark, "searches")
    payloads.stage(answers.withColumn("body", cut), place)
    return payloads.staged(spark, place, SEARCH_PAYLOAD)


@query
def staged_search_rows(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = _staged_searches(spark, sf)
    hits = payloads.search_hits(good.withColumnRenamed("key", "request_id"))
    return hits.withColumn("request_id", F.col("request_id").cast("long"))


@query
def staged_search_malformed(spark: SparkSession, sf: str) -> DataFrame:
    _, malformed = _staged_searches(spark, sf)
    return malformed.select(F.col("key").cast("long").alias("request_id"), F.length("body").alias("n_chars"))


@query
def id_batches(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.id_batches(star.music_info(spark, sf), "track_id")


@query
def top_tracks_report(spark: SparkSession, sf: str) -> DataFrame:
    records = _feature_records(spark, sf).withColumns(
        {f: F.round(f, 1) + F.lit(0.0) for f in ("energy", "danceability", "tempo")}
    )
    found = reports.top_tracks_report(_top_tracks(spark, sf), records)
    return found.select("user_id", "pos", "track_id", "line")


@query
def paired_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """Each listener's tracks beside the records of those that have one: the trap of pairing by position."""
    mine = _top_tracks(spark, sf).select("user_id", "pos", "track_id")
    records = (
        reports.tracks_with_features(mine, _feature_records(spark, sf), ["energy"])
        .select("user_id", F.col("pos").alias("listed"), _rounded("energy", "energy"))
    )
    return reports.paired_by_position(mine, records, ["user_id"], ["pos"], ["listed"]).select(
        "user_id", (F.col("place") - 1).cast("int").alias("pos"), "track_id", "energy"
    )


# ---- collaborative and ensemble -----------------------------------------------------------------


@query
def item_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    matrix = materialize(_interactions(spark, sf), "matrix")
    near = collaborative.item_neighbours(matrix.select("track_id"), matrix, 10)
    return near.select("seed_id", "track_id", "rank", _rounded("score", "score"))


@query
def collaborative_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    matrix = materialize(_interactions(spark, sf), "matrix")
    metadata = interactions.track_metadata(matrix, star.music_info(spark, sf))
    found = collaborative.collaborative_recommendations(
        star.misspelt_requests(spark, sf), matrix, metadata, 3
    )
    return found.withColumn("score", _rounded("score", "score"))


@query
def collaborative_top_tracks(spark: SparkSession, sf: str) -> DataFrame:
    matrix = materialize(_interactions(spark, sf), "matrix")
    metadata = interactions.track_metadata(matrix, star.music_info(spark, sf))
    asked = _top_tracks(spark, sf).select(
        (F.col("user_id") * 100 + F.col("pos")).alias("request_id"), F.col("name").alias("title"), "artist"
    )
    found = collaborative.collaborative_recommendations(asked, matrix, metadata, 10, "title")
    return found.select("request_id", "seed_id", "rank", "display_order", "track_id", "line")


@query
def ensemble(spark: SparkSession, sf: str) -> DataFrame:
    matrix = materialize(_interactions(spark, sf), "matrix")
    metadata = interactions.track_metadata(matrix, star.music_info(spark, sf))
    found = ensemble_recommendations(
        _resolved(spark, sf), star.tracks(spark, sf), matrix, metadata, FEATURES_4
    )
    return found.withColumn("score", _rounded("score", "score"))


# ---- listener profile and forest ----------------------------------------------------------------


@query
def play_counts(spark: SparkSession, sf: str) -> DataFrame:
    return listener.play_counts(star.scrobbles(spark, sf))


@query
def play_counts_numbered(spark: SparkSession, sf: str) -> DataFrame:
    counts = listener.play_counts(star.scrobbles(spark, sf))
    return numbering.number_rows(counts, [F.col("count").desc(), "artist", "track"], "place")


@query
def top_songs(spark: SparkSession, sf: str) -> DataFrame:
    return listener.top_songs(listener.play_counts(star.scrobbles(spark, sf)))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    hits = star.requests(spark, sf).join(_search_hits(spark, sf).select("request_id", "track_id"), "request_id")
    hits = hits.select("artist", F.col("title").alias("track"), F.col("track_id").alias("spotify_id"))
    return listener.listener_history(
        star.scrobbles(spark, sf), hits, _feature_records(spark, sf), FEATURES_11
    )


def _heard(spark: SparkSession, sf: str) -> DataFrame:
    return listener.usable_history(_history(spark, sf), FEATURES_11)


def _songs(spark: SparkSession, sf: str) -> DataFrame:
    return clean.songs_by_first_artist(star.tracks(spark, sf), FEATURES_11)


@query
def listener_history(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).select(
        "artist", "track", "count", "spotify_id", *[_rounded(f, f) for f in FEATURES_11]
    )


@query
def usable_history(spark: SparkSession, sf: str) -> DataFrame:
    return _heard(spark, sf).select("artist", "track", "count", "spotify_id")


@query
def weighted_features(spark: SparkSession, sf: str) -> DataFrame:
    heard = _heard(spark, sf)
    block = clean.weighted(heard, FEATURES_11, "count")
    return heard.select(
        "artist", "track", *[_rounded(c, f) for c, f in zip(block, FEATURES_11, strict=True)]
    )


@query
def taste_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = listener.taste_profile(_heard(spark, sf), FEATURES_11)
    return profile.select(*[_rounded(f, f) for f in FEATURES_11])


@query
def unheard_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return listener.candidates(_songs(spark, sf), _heard(spark, sf)).select("id", "artist", "track")


@query
def unheard_candidates_all_history(spark: SparkSession, sf: str) -> DataFrame:
    """Unheard against the whole history, songs without features included."""
    return listener.candidates(_songs(spark, sf), _history(spark, sf)).select("id", "artist", "track")


@query
def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    heard = _heard(spark, sf)
    rows = listener.training_rows(heard, listener.candidates(_songs(spark, sf), heard), FEATURES_11, 7)
    return rows.select("id", "artist", "track", F.col("count").cast("long").alias("count"))


@query
def sampled_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_exactly(star.music_info(spark, sf), ["track_id"], 150, 42)


@query
def split_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_exactly(star.music_info(spark, sf), ["track_id"], 0.2, 64)


@query
def sampled_fraction(spark: SparkSession, sf: str) -> DataFrame:
    plays = star.listens(spark, sf).select("user_id", "track_id", "playcount")
    return sampling.sample_fraction(plays, 0.1, 64)


@query
def prediction_error(spark: SparkSession, sf: str) -> DataFrame:
    """Error of predicting each song's plays by the mean plays of its artist."""
    counts = listener.play_counts(star.scrobbles(spark, sf))
    means = counts.groupBy("artist").agg(F.avg("count").alias("predicted_count"))
    return listener.squared_error(counts.join(means, "artist")).select(
        _rounded("mse", "mse"), _rounded(F.sqrt("mse"), "rmse")
    )


def _training(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    heard = materialize(_heard(spark, sf), "heard")
    unheard = materialize(listener.candidates(_songs(spark, sf), heard), "unheard")
    return heard, unheard


@query
def forest_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    heard, unheard = _training(spark, sf)
    runs, _ = listener.evaluate_forest(heard, unheard, FEATURES_11)
    return listener.error_summary(runs).select(_rounded("mse", "mse"), _rounded("rmse", "rmse"))


@query
def forest_without_negatives(spark: SparkSession, sf: str) -> DataFrame:
    heard, _ = _training(spark, sf)
    runs, _ = listener.evaluate_forest(heard, None, FEATURES_11, repeats=1)
    return runs.select("run", "seed", _rounded("mse", "mse"))


@query
def forest_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    heard, unheard = _training(spark, sf)
    rows = listener.training_rows(heard, unheard, FEATURES_11, 7)
    forest = listener.fit_forest(rows, FEATURES_11)
    return listener.forest_recommendations(forest, unheard).select(
        "id", "artist", "track", _rounded("predicted_count", "predicted_count")
    )


@query
def forest_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of one tree of depth 4, fitted on all songs of the listener."""
    heard, unheard = _training(spark, sf)
    rows = listener.training_rows(heard, unheard, FEATURES_11, 7)
    tree = listener.fit_forest(rows, FEATURES_11, trees=1, max_depth=4).nodes
    return tree.select("node", "feature", _rounded("threshold", "threshold"), _rounded("value", "value"), "n")


@query
def forest_of_one_song(spark: SparkSession, sf: str) -> DataFrame:
    """A forest on a single song predicts that song's count everywhere."""
    heard, unheard = _training(spark, sf)
    song = sampling.sample_exactly(heard, ["artist", "track"], 1, listener.FOREST_SEED)
    fitted = listener.constant_forest(song, FEATURES_11)
    return listener.forest_recommendations(fitted, unheard).select(
        "id", "artist", "track", _rounded("predicted_count", "predicted_count")
    )


# ---- clusters and projection --------------------------------------------------------------------


@query
def track_clusters(spark: SparkSession, sf: str) -> DataFrame:
    labelled = clusters.cluster_tracks(star.tracks(spark, sf), FEATURES_4)
    return labelled.select("id", "name", "cluster")


@query
def elbow(spark: SparkSession, sf: str) -> DataFrame:
    found = clusters.elbow_table(star.tracks(spark, sf), FEATURES_4)
    return found.select("k", _rounded("inertia", "inertia"))


@query
def total_inertia(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.elbow_table(star.tracks(spark, sf), FEATURES_4, largest_k=1).select(
        "k", _rounded("inertia", "inertia")
    )


@query
def projection_2d(spark: SparkSession, sf: str) -> DataFrame:
    flat = clusters.project_2d(star.tracks(spark, sf), FEATURES_4)
    return flat.select("id", _rounded("pc1", "pc1"), _rounded("pc2", "pc2"))
