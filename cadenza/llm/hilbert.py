"""Sharding along a Hilbert curve: quantise metadata, sort by curve index, cut equal runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import BROADCAST_KEYS, text_name, text_or_empty
from cadenza.operators.numbering import number_rows
from cadenza.session import materialize

#: Bits per dimension; three dimensions make an index below 2**18.
BITS = 6
#: Tasks that the rows of one text are dealt to where its group is looked up.
SALT = 16


#: Columns of the result; carried columns of these names give way to them.
OUT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve", "lang", "source")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of grid cells (rows of coordinates below 2**bits)."""
    x = np.array(cells, np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> bit & 1)
    return index


def _cells(df: DataFrame, column: str) -> DataFrame:
    """Each value's cell, by its place among the distinct values in code-point order; null comes first.

    Sent to every executor up to BROADCAST_KEYS values, counted first.
    """
    values = df.select(F.col(column).alias("_value")).distinct()
    ranked = number_rows(values, [F.col("_value").asc_nulls_first()], "_rank")
    total = ranked.count()
    cells = ranked.select("_value", F.floor((F.col("_rank") - 1) * (1 << BITS) / F.lit(max(total, 1))).cast("long").alias(f"_{column}"))
    return F.broadcast(cells) if total <= BROADCAST_KEYS else cells


def _size_cell(size: Column) -> Column:
    """A quarter of a power of two per cell."""
    return F.least(F.floor(F.log2(size.cast("double")) * F.lit(2)), F.lit((1 << BITS) - 1)).cast("long")


def _curves(langs: DataFrame, sources: DataFrame) -> DataFrame:
    """_lang, _source, _cell (of the size) and _curve of all cells in use: at most 2**18 rows, sent to every executor.

    So the rows themselves, with all they carry, never wait for a Python worker.
    """

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c], axis=1), BITS))

    sizes = langs.sparkSession.range(1 << BITS).select(F.col("id").alias("_cell"))
    used = langs.select("_lang").distinct().crossJoin(sources.select("_source").distinct()).crossJoin(F.broadcast(sizes))
    return F.broadcast(used.withColumn("_curve", curve("_lang", "_source", "_cell")))


def _group_places(documents: DataFrame) -> DataFrame:
    """name (of a text), group: the least lang and source of texts whose rows do not all have the same ones."""
    place = F.struct("lang", "source")
    groups = documents.select(text_name().alias("name"), place.alias("place")).groupBy("name").agg(F.min("place").alias("group"), F.max("place").alias("_most"))
    return materialize(groups.where(~F.col("group").eqNullSafe(F.col("_most"))).select("name", "group"), "shard-groups")


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the ``group`` of their text (``_name``), null if it has none. The commonest text is met in SALT tasks."""
    if groups.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(groups), F.col("_name") == F.col("name"), "left").drop("name")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(SALT))
    return rows.join(salted, (F.col("_name") == F.col("name")) & (own == F.col("salt")), "left").drop("name", "salt")


def shard(documents: DataFrame, n_shards: int = 16, carry: list[str] | None = None) -> DataFrame:
    """Shards of equal row counts (at most one apart), each a run of the Hilbert curve over lang, source and size.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (always null: this law
    moves rows when a shard is added), curve, lang, source, and the columns in ``carry``. Rows of equal texts lie in one
    cell, that of their least lang and source, and follow each other; only the end of a shard parts them. The order
    inside a cell is text_crc32, then text, then doc_id; rows repeated whole get neighbouring slots. A null text has size 1 and the
    CRC of no bytes; null lang and source are the lowest cells; a null doc_id comes first. Tables smaller
    than ``n_shards`` leave shards empty; an empty table gives no rows.
    """
    carry = [c for c in carry or [] if c not in OUT]
    text = text_or_empty()
    rows = documents.select(
        "doc_id", "lang", "source", (F.octet_length(text).cast("long") + 1).alias("_size"), F.crc32(text).alias("_crc"), text_name().alias("_name"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    rows = _with_group(rows, _group_places(documents))
    cells = {c: _cells(documents, c) for c in ("lang", "source")}
    for column in cells:
        own = F.when(F.col("group").isNull(), F.col(column)).otherwise(F.col(f"group.{column}"))
        rows = rows.withColumn(f"_own_{column}", own)
        rows = rows.join(cells[column], F.col(f"_own_{column}").eqNullSafe(F.col("_value")), "left").drop("_value")

    rows = rows.withColumn("_cell", _size_cell(F.col("_size"))).join(_curves(cells["lang"], cells["source"]), ["_lang", "_source", "_cell"])
    ordered = number_rows(rows, [F.col("_curve"), F.col("_crc"), F.col("_name"), F.col("doc_id").asc_nulls_first()], "_no")
    total = ordered.count()
    # Shard k holds the places from ceil(k * total / n_shards) on.
    ordered = ordered.withColumn("_place", F.col("_no") - 1)
    shard_no = F.expr(f"CAST(_place * {n_shards}L DIV {max(total, 1)}L AS INT)")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) DIV {n_shards}L")
    return (
        ordered.withColumn("shard", shard_no)
        .withColumn("slot", F.col("_place") - first)
        .select(
            "doc_id",
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.lit("rows").alias("law"),
            "shard",
            "slot",
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("_curve").alias("curve"),
            "lang",
            "source",
            *[F.col(f"_carry_{c}").alias(c) for c in carry],
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order, so that file statistics prune on lang, source and size."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
