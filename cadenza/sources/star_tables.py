"""Logical music tables laid over the star-schema Parquet files used for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.schema import FEATURES_9, FEATURES_11, TOP_TRACKS_PAYLOAD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue: one row per part that has an embedding; its first entries are the features.

    Both sides are shuffled: Spark would judge the few columns read of ``part`` by their compressed size and collect
    them on the driver.
    """
    names = ["danceability", "acousticness", "instrumentalness", "loudness"]
    names += [f for f in FEATURES_9 if f not in names]
    part = table(spark, sf_dir, "part")
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", 1, len(names)).alias("embedding"), "label"
    )
    return part.join(emb.hint("merge"), part.p_partkey == emb.vec_id).select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("['"), "p_brand", F.lit("']")).alias("artists"),
        *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(names)],
        F.col("label").alias("key"),
        (F.col("p_size") % 2).alias("mode"),
    )


def listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play counts per (user, track) line, with the columns that define arrival order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("track_id"),
        F.col("l_quantity").alias("playcount"),
        "l_orderkey",
        "l_linenumber",
    )


LISTEN_ORDER = ["l_orderkey", "l_linenumber", "playcount"]


def music_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("track_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("artist"),
    )


def scrobbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per play in a personal export."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("artist"), F.col("p_name").alias("track")
    )


def scrobbles_mbid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays with a track id that is sometimes missing."""
    return table(spark, sf_dir, "events").select(
        F.nullif("event_type", F.lit("error")).alias("track_mbid"), "event_id", "user_id", "value"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part asks for recommendations by its own title and artist."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
    )


def misspelt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests with the second character of each title lost and its case changed."""
    return requests(spark, sf_dir).withColumn(
        "title", F.upper(F.concat(F.substring("title", 1, 1), F.col("title").substr(3, 1000)))
    )


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue export with repeated ids and gaps: one row per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"),
        F.col("l_orderkey").alias("row_a"),
        F.col("l_linenumber").alias("row_b"),
        F.nullif("l_returnflag", F.lit("N")).alias("name"),
        F.col("l_linestatus").alias("artists"),
        F.col("l_quantity").alias("tempo"),
    )


def _record(features: list[str]):
    return F.struct(
        F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("https://open.example/track/"), F.col("id").cast("string"), F.lit("?x=1")).alias(
            "href"
        ),
        *features,
    )


def feature_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-service answers as JSON text, 40 catalogue tracks each."""
    per_call = 40
    return (
        tracks(spark, sf_dir)
        .groupBy(F.floor(F.col("id") / per_call).alias("call_no"))
        .agg(F.to_json(F.struct(F.collect_list(_record(FEATURES_11)).alias("content"))).alias("body"))
    )


def external_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature-service answer per part, with gaps; large parts are unknown to the service."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    gap = F.when(F.col("p_type") != "PROMO", F.col("p_size") / 100)
    known = _record(
        [
            (F.col("p_size") / 50).alias("danceability"),
            (F.col("p_retailprice") / 2000).alias("acousticness"),
            gap.alias("instrumentalness"),
            (-F.col("p_size").cast("double")).alias("loudness"),
        ]
    )
    content = F.when(F.col("p_size") <= 40, F.array(known))
    return part.select(
        F.col("id").alias("call_no"), F.to_json(F.struct(content.alias("content"))).alias("body")
    )


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers as JSON text, one per request; small parts are unknown to the service."""
    part = table(spark, sf_dir, "part")
    known = (
        part.where(F.col("p_size") > 10)
        .groupBy("p_name", "p_brand")
        .agg(F.min("p_partkey").alias("found"))
    )
    hit = F.struct(
        F.col("found").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.array(F.struct(F.lit("a").alias("id"), F.col("p_brand").alias("name"))).alias("artists"),
    )
    items = F.when(F.col("found").isNotNull(), F.array(hit)).otherwise(F.array().cast(_items_type()))
    return part.join(known, ["p_name", "p_brand"], "left").select(
        F.col("p_partkey").alias("request_id"),
        F.to_json(F.struct(F.struct(items.alias("items")).alias("tracks"))).alias("body"),
    )


def _items_type():
    return TOP_TRACKS_PAYLOAD["items"].dataType


def top_track_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's 20 most played tracks as JSON text."""
    plays = (
        listens(spark, sf_dir)
        .groupBy("user_id", "track_id")
        .agg(F.sum("playcount").alias("plays"))
        .withColumn(
            "place",
            F.row_number().over(
                Window.partitionBy("user_id").orderBy(F.col("plays").desc(), "track_id")
            ),
        )
        .where("place <= 20")
    )
    entry = F.struct(
        "place",
        F.col("track_id").cast("string").alias("id"),
        "name",
        F.array(F.struct(F.lit("a").alias("id"), F.col("artist").alias("name"))).alias("artists"),
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["id"], e["name"], e["artists"])
    )
    return (
        plays.join(music_info(spark, sf_dir), "track_id")
        .groupBy("user_id")
        .agg(F.to_json(F.struct(ordered.alias("items"))).alias("body"))
    )
