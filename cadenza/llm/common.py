"""What the operators share: reading texts as byte arrays inside Arrow batches, and 64-bit hashes of words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import shared_dir

#: Bytes of text worked on at once inside a task; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key() -> Column:
    """Names a row by its id and text, so that null and repeated ids do no harm."""
    return F.xxhash64(F.col("doc_id"), text_or_empty())


def row_name() -> Column:
    """Names a row by its id and text in 128 bits, where the name decides what is dropped."""
    given = F.when(F.col("doc_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("doc_id").cast("string")))
    return F.unhex(F.md5(F.concat(given, F.lit("|"), text_or_empty()).cast("binary")))


def text_name() -> Column:
    """Names a text in 128 bits; null counts as empty."""
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def unused(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    while name in rows.columns:
        name += "_"
    return name


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string")) % n


class Texts:
    """Texts of one piece: all their UTF-8 bytes in ``data``; text ``i`` is ``data[at[i]:at[i + 1]]``."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(raw[at[0] : at[-1]], at - at[0])

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text each byte position belongs to."""
        return np.searchsorted(self.at, positions, "right") - 1


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cuts batches into runs of whole rows with about PIECE_BYTES of text."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_string()).fill_null("")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, "right")) - 1)
            yield batch.slice(first, last - first), Texts.of(column.slice(first, last - first))
            first = last


def per_piece(fn: Callable[[pa.RecordBatch, Texts], pa.RecordBatch]) -> Callable:
    """A function for mapInArrow that works on one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            yield fn(batch, texts)

    return run


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of other bytes than 0x20 and 0x09-0x0D; none spans two texts."""
    blank = np.zeros(256, bool)
    blank[[0x20, 9, 10, 11, 12, 13]] = True
    inside = ~blank[texts.data]
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[texts.at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """64-bit polynomial hashes of any stretches of a byte array, from running sums."""

    def __init__(self, lower: bool = False):
        values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            values[65:91] = values[97:123]
        self.values = values
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            room = max(n, PIECE_BYTES + 4096)
            up = np.full(room, _BASE, np.uint64)
            up[0] = 1
            down = np.full(room, pow(_BASE, -1, 2**64), np.uint64)
            down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=total[1:])
        return total

    def stretches(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def every(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of ``width`` bytes from each position on."""
        n = max(0, len(sums) - width)
        return mix((sums[width:] - sums[:n]) * self.down[:n])


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


#: Up to so many 8-byte keys are sent to every executor, counted first; more are met by a shuffle.
BROADCAST_KEYS = 250_000


def keep_keys(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``keys`` (distinct, already written), without shuffling the rows when there are few keys."""
    small = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if small else keys.hint("shuffle_hash"), on, "left_semi")


def drop_keys(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in ``keys``; the same choice as in keep_keys."""
    small = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if small else keys.hint("shuffle_hash"), on, "left_anti")


def store_packed(df: DataFrame, label: str) -> DataFrame:
    """Like materialize, for tables that carry texts: written with the stronger compression."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
