"""Tables that appear whole or not at all: written beside, verified, then published by a manifest.

A table is a folder with one subfolder per version. Readers go by the manifests alone: the newest one names the
version to read and its schema, so a write that failed, or still goes on, is never seen.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version long, folder string, format string, options string, schema string, row_count long, checksum long"


def _facts(df: DataFrame) -> list:
    """Row count, and a checksum that the order of rows does not change."""
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("sum")]


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{path}/manifests/*")


def _load(spark: SparkSession, entry) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    return spark.read.schema(schema).options(**json.loads(entry["options"])).format(entry["format"]).load(entry["folder"])


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version of a table."""
    newest = _manifests(spark, path).orderBy(F.desc("version")).first()
    if newest is None:
        raise FileNotFoundError(f"{path}: nothing has been published")
    return _load(spark, newest)


def publish(df: DataFrame, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """Write ``df`` as a new version of the table at ``path`` and return the published table.

    The rows are counted and summed up while they are written, and again from the files; only if both agree, in the
    declared types, is the manifest written. Otherwise the version stays unpublished and an error is raised.
    """
    spark = df.sparkSession
    folder = f"{path}/versions/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, *_facts(df)).write.options(**options).format(format).save(folder)
    given = seen.get
    entry = {
        "folder": folder, "format": format, "options": json.dumps(options), "schema": df.schema.json(),
        "row_count": given["n"], "checksum": given["sum"],
    }
    found = _load(spark, entry).agg(*_facts(df)).first()
    if (found["n"], found["sum"]) != (given["n"], given["sum"]):
        raise ValueError(f"{folder}: {found['n']} rows read of {given['n']} written, or other values; not published")
    try:
        version = 1 + (_manifests(spark, path).agg(F.max("version")).first()[0] or 0)
    except Exception as error:  # noqa: BLE001  (no manifest yet: the folder does not exist)
        if "PATH_NOT_FOUND" not in str(error):
            raise
        version = 1
    names = [c.split()[0] for c in _MANIFEST.split(", ")]
    row = tuple({**entry, "version": version}[n] for n in names)
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.json(f"{path}/manifests/{version:012d}-{uuid.uuid4().hex}")
    return published(spark, path)


def published_folder(spark: SparkSession, path: str) -> str:
    """The folder of the newest version, for readers with rules of their own."""
    return _manifests(spark, path).orderBy(F.desc("version")).first()["folder"]
