"""Staged JSON answers of the feature, search and top-tracks services, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.text import first_of
from cadenza.operators.numbering import number_rows
from cadenza.schema import FEATURE_PAYLOAD, SEARCH_PAYLOAD, TOP_TRACKS_PAYLOAD

# Ids per feature request, songs in a top-tracks answer.
IDS_PER_CALL = 40
TOP_TRACKS = 20
#: Folders of a staged table.
STAGE_BUCKETS = 64


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Staged files, one JSON document per line, read with a declared schema."""
    return spark.read.schema(schema).json(path)


def parse_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Replace a text column by the fields of the document in it."""
    others = [c for c in df.columns if c != column]
    return df.withColumn("_doc", F.from_json(column, schema)).select(*others, "_doc.*")


def _or_empty(array: Column, element: T.DataType) -> Column:
    return F.coalesce(array, F.array().cast(T.ArrayType(element)))


def feature_records(payloads: DataFrame) -> DataFrame:
    """One row per record in ``content``; an answer without the field has no records."""
    element = FEATURE_PAYLOAD["content"].dataType.elementType
    others = [c for c in payloads.columns if c != "content"]
    return payloads.select(
        *others, F.explode(_or_empty(F.col("content"), element)).alias("_record")
    ).select(*others, "_record.*")


def top_tracks(payloads: DataFrame, limit: int = TOP_TRACKS) -> DataFrame:
    """pos (0-based), track_id, name and first artist of each listed track."""
    others = [c for c in payloads.columns if c != "items"]
    element = TOP_TRACKS_PAYLOAD["items"].dataType.elementType
    return (
        payloads.select(*others, F.posexplode(_or_empty(F.col("items"), element)).alias("pos", "item"))
        .where(F.col("pos") < limit)
        .select(
            *others,
            "pos",
            F.col("item.id").alias("track_id"),
            F.col("item.name").alias("name"),
            first_of("item.artists").getField("name").alias("artist"),
        )
    )


def search_hits(payloads: DataFrame) -> DataFrame:
    """The first hit of each search answer; NULL fields where the search found nothing."""
    others = [c for c in payloads.columns if c != "tracks"]
    hit = first_of("tracks.items")
    return payloads.select(
        *others,
        hit.getField("id").alias("track_id"),
        hit.getField("name").alias("name"),
        first_of(hit.getField("artists")).getField("name").alias("artist"),
    )


def id_batches(ids: DataFrame, column: str, size: int = IDS_PER_CALL) -> DataFrame:
    """Comma-joined request keys of at most ``size`` ids each: batch_no, ids, n_ids."""
    numbered = number_rows(ids.select(column), [column], "_no")
    return (
        numbered.groupBy(F.floor((F.col("_no") - 1) / size).alias("batch_no"))
        .agg(F.sort_array(F.collect_list(column)).alias("_ids"))
        .select(
            "batch_no",
            F.array_join(F.transform("_ids", lambda x: x.cast("string")), ",").alias("ids"),
            F.size("_ids").alias("n_ids"),
        )
    )


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(STAGE_BUCKETS)).cast("int")


def stage(answers: DataFrame, path: str, key: str = "request_id", body: str = "body") -> None:
    """Keep answers as JSON text under the request they belong to, in folders by a hash of it.

    A lookup of some requests then opens the files of their folders alone.
    """
    text = answers.select(F.col(key).cast("string").alias("key"), F.col(body).alias("body"), _bucket(key).alias("bucket"))
    text.repartition("bucket").write.partitionBy("bucket").parquet(path)


def staged(spark: SparkSession, path: str, schema: T.StructType, keys: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Staged answers as (documents, malformed): key and the declared fields, and key and body of what is no such document.

    ``keys`` picks requests; only the folders they hash to are read. A missing body is malformed, an empty
    object is a document without fields, and so is a document with fields of other types under those names.
    """
    layout = "key string, body string, bucket int"
    rows = spark.read.schema(layout).parquet(path)
    if keys is not None:
        picked = spark.range(1).select(F.explode(F.array(*[F.lit(str(k)) for k in keys])).alias("key"))
        buckets = [r[0] for r in picked.select(_bucket("key")).distinct().collect()]  # one number a key asked for
        rows = rows.where(F.col("bucket").isin(buckets) & F.col("key").isin([str(k) for k in keys]))
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    parsed = rows.select("key", "body", F.from_json("body", corrupt, options).alias("_doc"))
    bad = F.col("_doc").isNull() | F.col("_doc._corrupt").isNotNull()
    good = parsed.where(~bad).select("key", *[F.col(f"_doc.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.where(bad).select("key", "body")


def read_feature_records(spark: SparkSession, path: str) -> DataFrame:
    return feature_records(read_json(spark, path, FEATURE_PAYLOAD))


def read_top_tracks(spark: SparkSession, path: str, limit: int = TOP_TRACKS) -> DataFrame:
    return top_tracks(read_json(spark, path, TOP_TRACKS_PAYLOAD), limit)


def read_search_hits(spark: SparkSession, path: str) -> DataFrame:
    """Answers staged with the request they belong to (a ``request_id`` field beside ``tracks``)."""
    schema = T.StructType([T.StructField("request_id", T.LongType()), *SEARCH_PAYLOAD.fields])
    return search_hits(read_json(spark, path, schema))
