"""Exact duplicates across immutable snapshots and a new batch, screened by static binary-fuse filters.

Each snapshot's digests are dealt into slots by their leading bits; every slot gets one three-wise
binary-fuse filter (8-bit fingerprints). A later part's distinct digests meet the filters slot by slot. Only
the positives are joined with the snapshot's exact digests, and their texts compared byte by byte. Duplicates
inside a part are grouped by themselves first, so a text with any number of copies is one row from there on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import mix, text_or_empty
from cadenza.session import materialize

#: Digests a slot should hold; the number of slots follows the snapshot's size.
SLOT_DIGESTS = 50_000
#: Up to so many ids (8 bytes each) are sent to every executor, counted first; more are shuffled.
BROADCAST_IDS = 250_000


class FuseFilter:
    """Three-wise binary-fuse filter over distinct 64-bit keys: no false negatives, about 1 in 256 positives."""

    def __init__(self, seed: int, segment: int, table: np.ndarray):
        self.seed, self.segment, self.table = seed, segment, table

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Three cells in consecutive segments for each key, and its fingerprint."""
        h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(n_segments) >> np.uint64(32)).astype(np.int64)
        other = mix(h + np.uint64(1))
        mask = segment - 1
        inside = [(h & np.uint64(mask)).astype(np.int64), (other & np.uint64(mask)).astype(np.int64),
                  (other >> np.uint64(24) & np.uint64(mask)).astype(np.int64)]
        cells = np.stack([(first + i) * segment + inside[i] for i in range(3)], axis=1)
        return cells, (other >> np.uint64(56)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys)
        n = max(len(keys), 1)
        segment = max(4, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25))) if n > 1 else 4
        room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
        n_segments = max(1, -(-room // segment))
        for seed in range(1, 200):
            cells, prints = cls._places(keys, seed, segment, n_segments)
            rounds = cls._peel(cells, (n_segments + 2) * segment)
            if rounds is not None:
                table = np.zeros((n_segments + 2) * segment, np.uint8)
                for who, at in reversed(rounds):  # no key of a round reads a cell that another one owns
                    own = cells[who]
                    table[at] = prints[who] ^ table[own[:, 0]] ^ table[own[:, 1]] ^ table[own[:, 2]]
                return cls(seed, segment, table)
        raise RuntimeError("no seed peels the key set")

    @staticmethod
    def _peel(cells: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, cell that only this key still uses), or None if a core remains."""
        counts = np.bincount(cells.ravel(), minlength=size)
        xor = np.zeros(size, np.int64)
        np.bitwise_xor.at(xor, cells.ravel(), np.repeat(np.arange(len(cells)), 3))
        rounds, left = [], len(cells)
        while left:
            lone = np.flatnonzero(counts == 1)
            if not len(lone):
                return None
            keys, first = np.unique(xor[lone], return_index=True)
            rounds.append((keys, lone[first]))
            np.subtract.at(counts, cells[keys].ravel(), 1)
            np.bitwise_xor.at(xor, cells[keys].ravel(), np.repeat(keys, 3))
            left -= len(keys)
        return rounds

    def has(self, keys: np.ndarray) -> np.ndarray:
        n_segments = len(self.table) // self.segment - 2
        cells, prints = self._places(keys, self.seed, self.segment, n_segments)
        return (self.table[cells[:, 0]] ^ self.table[cells[:, 1]] ^ self.table[cells[:, 2]]) == prints


def build_filters(digests: DataFrame) -> DataFrame:
    """One filter row per slot of a snapshot's distinct digests: slot, seed, segment, cells."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "cells": [f.table.tobytes()]})

    return digests.select("slot", "key").groupBy("slot").applyInPandas(build, "slot long, seed long, segment long, cells binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests of ``incoming`` (slot, key, ...) that the snapshot may hold."""

    def ask(rows: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or one.empty:
            return rows.iloc[:0]
        f = FuseFilter(int(one["seed"].iloc[0]), int(one["segment"].iloc[0]), np.frombuffer(one["cells"].iloc[0], np.uint8))
        return rows[f.has(rows["key"].to_numpy().view(np.uint64))]

    return incoming.groupBy("slot").cogroup(filters.groupBy("slot")).applyInPandas(ask, incoming.schema)


def _same_bytes(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Of ``pairs`` (sha, part, earlier, id, earlier_id) those whose two texts are equal byte by byte."""
    ids = materialize(
        pairs.select(F.col("id").alias("_id")).union(pairs.select("earlier_id")).where("_id is not null").distinct(), "fuse-ids"
    )
    few = ids.count() <= BROADCAST_IDS
    texts = documents.select(F.col("doc_id").alias("_id"), text_or_empty().alias("_text"))
    texts = texts.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "_id", "left_semi")
    texts = texts.select("_id", "_text", F.unhex(F.sha2("_text", 256)).alias("sha"))
    sides = pairs.select("sha", "part", "earlier", F.explode(F.array("id", "earlier_id")).alias("_id"))
    return (
        sides.join(texts, ["sha", "_id"])
        .groupBy("sha", "part", "earlier")
        .agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
        .where(F.col("_low") == F.col("_high"))
        .select("sha", "part", "earlier")
    )


def dedup(parts: list[DataFrame]) -> DataFrame:
    """Groups of equal texts over snapshots (oldest first) and a new batch (last).

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row. The row with the largest
    doc_id stays; of rows repeated with that id, one. A null text counts as empty, a null doc_id is the smallest.
    Other columns are ignored. An empty part or an empty table gives no rows for it.
    """
    rows = None
    for i, part in enumerate(parts):
        one = part.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("sha"), F.lit(i).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "fuse-rows")
    n_slots = 1 + rows.count() // SLOT_DIGESTS
    groups = materialize(
        rows.groupBy("part", "sha")
        .agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count("*").alias("n"))
        .withColumn("key", F.xxhash64("sha"))
        .withColumn("slot", F.pmod("key", F.lit(n_slots))),
        "fuse-groups",
    )
    pairs = None
    for j in range(len(parts) - 1):
        snapshot = groups.where(F.col("part") == j)
        maybe = screen(groups.where(F.col("part") > j).select("slot", "key", "sha", "part", F.col("best.doc_id").alias("id")), build_filters(snapshot))
        exact = snapshot.select("sha", F.lit(j).alias("earlier"), F.col("best.doc_id").alias("earlier_id"))
        found = maybe.join(exact, "sha").select("sha", "part", "earlier", "id", "earlier_id")
        pairs = found if pairs is None else pairs.unionByName(found)
    resolved = groups.select("sha", "part", F.col("part").alias("root"), "best", "n")
    if pairs is not None:
        same = _same_bytes(materialize(pairs, "fuse-pairs"), parts_union(parts))
        first = same.groupBy("sha", "part").agg(F.min("earlier").alias("earlier"))
        resolved = groups.join(first, ["sha", "part"], "left").select(
            "sha", "part", F.coalesce("earlier", "part").alias("root"), "best", "n"
        )
    resolved = materialize(resolved, "fuse-resolved")
    totals = resolved.groupBy("sha", "root").agg(F.max("best").alias("keep"), F.sum("n").alias("group_size"))
    answers = resolved.select("sha", "part", "root").join(totals, ["sha", "root"])
    return rows.join(answers, ["sha", "part"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("keep.uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def parts_union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0].select("doc_id", "text")
    for part in parts[1:]:
        whole = whole.unionByName(part.select("doc_id", "text"))
    return whole


def thirds(documents: DataFrame) -> list[DataFrame]:
    """Two snapshots and a new batch: documents in order of arrival, as their ids tell it."""
    low, high = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [documents]
    a, b = low + (high - low) // 3, low + 2 * (high - low) // 3
    doc_id = F.col("doc_id")
    return [documents.where(doc_id <= a), documents.where((doc_id > a) & (doc_id <= b)), documents.where((doc_id > b) | doc_id.isNull())]
