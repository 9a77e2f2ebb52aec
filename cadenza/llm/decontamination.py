"""Benchmark passages inside documents, found by latent semantic retrieval and confirmed word by word.

Items are cut into pieces of at most PIECE_WORDS words. Over the words of the items, TF-IDF rows of the pieces and of all
passages of the corpus go through a randomised SVD: Spark sums the products of its passes, the driver
orthogonalises them. Every document is then covered by overlapping windows. Two bounds, both differences of running
sums, drop windows that cannot reach the cosine asked for: their words outside the items, and the most that
each word can add to the cosine with any piece. The others are folded into the latent space and compared with
all pieces. A candidate counts when the longest common subsequence of words covers most
of the piece, or half of it together with the item's answer, its last sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cadenza.llm.common import Hasher, Texts, drop_keys, pieces, row_name, text_or_empty, unused
from cadenza.session import materialize

PIECE_WORDS = 64
#: Window lengths and the steps between windows of each, in words.
COVERS = ((16, 4), (32, 8), (64, 16))
#: Words share 2**18 document-frequency cells by their hash.
CELLS = 1 << 18
SLICE = 1 << 12
#: Dimensions beyond the pieces'; pieces of one index; its most frequent words, multiplied as dense columns.
MORE_DIMENSIONS, INDEX_PIECES, DENSE_WORDS = 32, 256, 1024
#: Least cosine of a candidate; share of a piece that must be found, alone and with its answer; share of the answer.
COSINE, FOUND, FOUND_WITH_ANSWER, ANSWER = 0.5, 0.75, 0.5, 0.8


def folded() -> Column:
    """The text in lower case, of all scripts; empty for null."""
    return F.lower(text_or_empty())


def word_runs(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits; punctuation and case do not matter."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    inside = table[texts.data]
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[texts.at] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashed_words(texts: Texts, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (and the end)."""
    starts, ends = word_runs(texts)
    return hasher.stretches(hasher.sums(texts.data), starts, ends), np.searchsorted(starts, texts.at)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def spans(at: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all texts: first word, end, owning text. A window ends where its text does."""
    n = np.diff(at)
    each = np.where(n > 0, 1 + -(-np.maximum(n - length, 0) // step), 0)
    owner = np.repeat(np.arange(len(n)), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    first = at[owner] + nth * step
    return first, np.minimum(first + length, at[owner + 1]), owner


def _passage_counts(documents: DataFrame) -> tuple[int, np.ndarray]:
    """Number of passages in the corpus (PIECE_WORDS words each) and how many hold a word of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, n = Hasher(lower=True), np.zeros(CELLS, np.int64), 0
        for _, texts in pieces(batches):
            hashes, at = hashed_words(texts, hasher)
            first, end, _ = spans(at, PIECE_WORDS, PIECE_WORDS)
            grid = np.full((len(first), PIECE_WORDS), CELLS, np.int32)  # one passage a row; CELLS where it is short
            grid[np.arange(PIECE_WORDS) < (end - first)[:, None]] = cells(hashes)
            grid.sort(axis=1)
            fresh = np.ones(grid.shape, bool)
            fresh[:, 1:] = grid[:, 1:] != grid[:, :-1]
            seen += np.bincount(grid[fresh], minlength=CELLS + 1)[:CELLS]
            n += len(first)
        parts = [seen[i : i + SLICE].tobytes() for i in range(0, CELLS, SLICE)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] + [0] * (len(parts) - 1))], ["slice", "seen", "n"]
        )

    rows = documents.select(folded().alias("text")).mapInArrow(run, "slice int, seen binary, n long")
    total = _summed(rows, np.int64, "n long")
    return int(total["n"].sum()), np.concatenate([np.frombuffer(b, np.int64) for b in total["seen"]]) if len(total) else np.zeros(CELLS, np.int64)


def _summed(rows: DataFrame, dtype: type, extra: str = "") -> pd.DataFrame:
    """Adds up the arrays of each slice in Spark, a chunk of rows at a time; one row per slice reaches the driver."""
    value = "seen" if extra else "part"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            counts = batch.column("n").to_pylist() if extra else [0] * len(batch)
            for i, part, n in zip(batch.column("slice").to_pylist(), batch.column(value), counts):
                have = sums.setdefault(i, [0, 0])
                have[0] = have[0] + np.frombuffer(part.as_buffer(), dtype)
                have[1] += n
        columns = [pa.array(list(sums), pa.int32()), pa.array([v[0].tobytes() for v in sums.values()], pa.binary())]
        names = ["slice", value]
        if extra:
            columns.append(pa.array([v[1] for v in sums.values()], pa.int64()))
            names.append("n")
        yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"slice int, {value} binary" + (f", {extra}" if extra else "")
    return rows.repartition("slice").mapInArrow(add, schema).toPandas().sort_values("slice")


@dataclass
class Piece:
    item: int
    words: np.ndarray
    answer: np.ndarray


def cut_items(items: list[Row]) -> list[Piece]:
    """Pieces of all items that have words, with the words of the item's last sentence as its answer."""
    hasher, out = Hasher(lower=True), []
    for row in items:
        text = row["text"] or ""
        whole, _ = hashed_words(Texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])), hasher)
        ends = [s for s in text.replace("\n", " ").rstrip(" .!?").replace("!", ".").replace("?", ".").split(". ") if s.strip()]
        last = ends[-1].encode() if ends else b""
        answer, _ = hashed_words(Texts(np.frombuffer(last, np.uint8), np.array([0, len(last)])), hasher)
        n = -(-len(whole) // PIECE_WORDS)
        for i in range(n):  # nearly equal pieces
            out.append(Piece(row["item_id"], whole[len(whole) * i // n : len(whole) * (i + 1) // n], answer))
    return out


@dataclass
class Index:
    """Latent space of some pieces: words, their idf and place, and the pieces' coordinates."""

    pieces: list[Piece]
    vocabulary: np.ndarray
    idf: np.ndarray  # by cell
    basis: np.ndarray  # word of the vocabulary, dimension
    coordinates: np.ndarray  # piece, dimension; unit TF-IDF rows folded in
    reach: np.ndarray  # word of the vocabulary: the most that one occurrence adds to a piece's product; then 0

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def counts_of(index: Index, places: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each word of the vocabulary is in each window: row, word, count."""
    length = end - first
    row = np.repeat(np.arange(len(first)), length)
    token = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)
    known = places[token] >= 0
    both, tf = np.unique(row[known] * len(index.vocabulary) + places[token[known]], return_counts=True)
    return both // len(index.vocabulary), both % len(index.vocabulary), tf


def rows_of(index: Index, places: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows of windows over the vocabulary: row, word, weight sqrt(tf) * idf."""
    row, word, tf = counts_of(index, places, first, end)
    return row, word, np.sqrt(tf) * index.idf[cells(index.vocabulary[word])]


def fold(index: Index, row: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Coordinates of sparse rows in the latent space."""
    out = np.zeros((n, index.basis.shape[1]), np.float32)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    for a in range(0, len(first), 1024):
        stop = first[a + 1024] if a + 1024 < len(first) else len(row)
        part = slice(first[a], stop)
        out[row[first[a : a + 1024]]] = np.add.reduceat(index.basis[word[part]] * weight[part, None], first[a : a + 1024] - first[a])
    return out


def _passages(documents: DataFrame, index: Index) -> DataFrame:
    """Words of the vocabulary in every passage of the corpus, a row of packed arrays for each stretch of text.

    ``ends`` says where a passage's words end, ``energy`` is the squared length of its whole TF-IDF row.
    """
    narrow = np.min_scalar_type(max(len(index.vocabulary) - 1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for _, texts in pieces(batches):
            hashes, at = hashed_words(texts, hasher)
            first, end, _ = spans(at, PIECE_WORDS, PIECE_WORDS)
            row, word, tf = counts_of(index, index.places(hashes), first, end)
            energy = np.concatenate([[0.0], np.cumsum(index.idf[cells(hashes)].astype(np.float64) ** 2)])
            held, n = np.unique(row, return_counts=True)
            columns = word.astype(narrow), tf.astype(np.uint8), np.cumsum(n).astype(np.int32), (energy[end] - energy[first])[held].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["word", "tf", "ends", "energy"])

    rows = documents.select(folded().alias("text"))
    return rows.mapInArrow(run, "word binary, tf binary, ends binary, energy binary").where(F.octet_length("word") > 0)


def _times(rows: DataFrame, factor: np.ndarray, index: Index, dense: np.ndarray, inner: bool = False) -> np.ndarray:
    """A'(A X) for the unit TF-IDF rows A of the passages, or (A X)'(A X) if ``inner``.

    The words ``dense`` are multiplied as dense columns, the others by gathering.
    """
    n, width = factor.shape
    narrow = np.min_scalar_type(max(n - 1, 0))
    idf = index.idf[cells(index.vocabulary)]
    column = np.full(n, -1)
    column[dense] = np.arange(len(dense))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of_dense = np.zeros((width if inner else n, width)), factor[dense]
        some = False
        for batch in batches:
            for packed in zip(*(batch.column(c) for c in ("word", "tf", "ends", "energy"))):
                some = True
                word, tf, ends, energy = (np.frombuffer(p.as_buffer(), t) for p, t in zip(packed, (narrow, np.uint8, np.int32, np.float32)))
                cut = np.concatenate([[0], ends])
                row = np.repeat(np.arange(len(ends)), np.diff(cut))
                weight = (np.sqrt(tf, dtype=np.float32) * idf[word] / np.sqrt(np.maximum(energy, 1e-9))[row]).astype(np.float32)
                for a in range(0, len(ends), 512):
                    b = min(a + 512, len(ends))
                    part = slice(cut[a], cut[b])
                    in_row, place, w = row[part] - a, column[word[part]], weight[part]
                    often = place >= 0
                    grid = np.zeros((b - a, len(dense)), np.float32)
                    grid[in_row[often], place[often]] = w[often]
                    product = grid @ of_dense
                    r, at, w = in_row[~often], word[part][~often].astype(np.int64), w[~often, None]
                    if len(r):
                        new = np.flatnonzero(np.diff(r, prepend=-1))
                        product[r[new]] += np.add.reduceat(factor[at] * w, new)
                    if inner:
                        total += product.T @ product
                        continue
                    total[dense] += grid.T @ product
                    if len(r):
                        order = np.argsort(at, kind="stable")
                        at = at[order]
                        new = np.flatnonzero(np.diff(at, prepend=-1))
                        total[at[new]] += np.add.reduceat(product[r[order]] * w[order], new)
        step = max(1, -(-len(total) // 16))
        parts = [total[i : i + step].astype(np.float32).tobytes() for i in range(0, len(total), step)] if some else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["slice", "part"])

    sums = _summed(rows.mapInArrow(run, "slice int, part binary"), np.float32)
    return np.concatenate([np.frombuffer(b, np.float32) for b in sums["part"]]).reshape(-1, width) if len(sums) else np.zeros((width if inner else n, width), np.float32)


def build(documents: DataFrame, some: list[Piece], n_passages: int, seen: np.ndarray) -> Index:
    """Fits the latent space on every passage: pieces weigh as much as the whole corpus, so that it holds their directions."""
    idf = np.log((1.0 + n_passages) / (1.0 + np.minimum(seen, n_passages))).astype(np.float32) + np.float32(0.05)
    vocabulary = np.unique(np.concatenate([p.words for p in some]))
    size = len(vocabulary)
    rank = min(len(some) + MORE_DIMENSIONS, size)
    index = Index(some, vocabulary, idf, np.zeros((size, 1), np.float32), np.zeros((len(some), 1), np.float32), np.zeros(size + 1))
    hashes = np.concatenate([p.words for p in some])
    end = np.cumsum([len(p.words) for p in some])
    first = end - [len(p.words) for p in some]
    row, word, weight = rows_of(index, index.places(hashes), first, end)
    norm = np.sqrt(np.bincount(row, weight**2, len(some)))
    weight = (weight / np.maximum(norm[row], 1e-9)).astype(np.float32)
    own = np.zeros((len(some), size), np.float32)
    own[row, word] = weight
    passages = materialize(_passages(documents, index), "lsa-passages")
    dense = np.sort(np.argsort(-seen[cells(vocabulary)], kind="stable")[:DENSE_WORDS])

    weigh = np.float32(max(n_passages, 1))
    draw = np.random.default_rng(11).normal(size=(size, min(rank + 8, size))).astype(np.float32)
    q, _ = np.linalg.qr((_times(passages, draw, index, dense) + weigh * (own.T @ (own @ draw))).astype(np.float64))
    side = own @ q.astype(np.float32)
    product = (_times(passages, q.astype(np.float32), index, dense, inner=True) + weigh * (side.T @ side)).astype(np.float64)
    value, vector = np.linalg.eigh((product + product.T) / 2)
    index.basis = np.ascontiguousarray((q @ vector[:, np.argsort(-value)[:rank]]).astype(np.float32))
    index.coordinates = fold(index, row, word, weight, len(some))
    best = np.maximum((index.basis @ index.coordinates.T).max(axis=1), 0)
    index.reach[:size] = best * idf[cells(vocabulary)]
    return index


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table as one long integer."""
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Finder:
    def __init__(self, index: Index):
        self.index, self.hasher = index, Hasher(lower=True)

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """Windows and pieces with at least the cosine asked for: text, first word, end, piece, cosine."""
        index = self.index
        places = index.places(hashes)
        energy = index.idf[cells(hashes)].astype(np.float64) ** 2
        known = np.concatenate([[0.0], np.cumsum(np.where(places >= 0, energy, 0.0))])
        total = np.concatenate([[0.0], np.cumsum(energy)])
        most = np.concatenate([[0.0], np.cumsum(index.reach[places])])  # place -1 is the 0 at the end
        for length, step in COVERS:
            first, end, owner = spans(at, length, step)
            norm = total[end] - total[first]
            # Repeats weigh less than their number, so the sum of reaches is no smaller than any product; 0.999 for rounding.
            reachable = most[end] - most[first] >= 0.999 * COSINE * np.sqrt(norm)
            open_ = np.flatnonzero((known[end] - known[first] >= COSINE**2 * norm) & reachable)
            for a in range(0, len(open_), 4096):
                rows = open_[a : a + 4096]
                row, word, weight = rows_of(index, places, first[rows], end[rows])
                z = fold(index, row, word, weight.astype(np.float32), len(rows))
                cosine = z @ index.coordinates.T / np.sqrt(np.maximum(norm[rows], 1e-9))[:, None]
                for i, j in zip(*np.nonzero(cosine >= COSINE)):
                    r = rows[i]
                    yield int(owner[r]), int(first[r]), int(end[r]), int(j), float(cosine[i, j])

    def find(self, texts: Texts) -> list[tuple[int, int, float, float, float]]:
        """Confirmed passages: text, item, cosine, share of the piece found, share of the answer found."""
        hashes, at = hashed_words(texts, self.hasher)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        done: set[tuple[int, int, int]] = set()
        for text, first, end, j, cosine in sorted(self.candidates(hashes, at), key=lambda c: -c[4]) if len(self.index.vocabulary) else ():
            piece = self.index.pieces[j]
            have = best.get((text, piece.item))
            if have and have[1] >= FOUND:
                continue
            near = (text, j, (first + end) // 16)  # windows a few words apart see the same surroundings
            if near in done:
                continue
            done.add(near)
            room = len(piece.words)
            around = hashes[max(first - room, at[text]) : min(end + room, at[text + 1])]
            share = common_words(piece.words, around) / room
            answer = common_words(piece.answer, around) / len(piece.answer) if len(piece.answer) else 0.0
            if (share >= FOUND or (share >= FOUND_WITH_ANSWER and answer >= ANSWER)) and (not have or share > have[1]):
                best[text, piece.item] = (cosine, share, answer)
        return [(text, item, *v) for (text, item), v in sorted(best.items(), key=lambda hit: (hit[0][0], hit[0][1] is not None, hit[0][1] or 0))]


def blocks(benchmark: DataFrame) -> Iterator[list[Piece]]:
    """Pieces of the benchmark, the query set, INDEX_PIECES at a time; the driver reads one part of the sorted table after the other."""
    items = benchmark.select("item_id", folded().alias("text"))
    held: list[Piece] = []
    for row in items.orderBy("item_id", "text").toLocalIterator():
        held += cut_items([row])
        while len(held) >= INDEX_PIECES:
            yield held[:INDEX_PIECES]
            held = held[INDEX_PIECES:]
    if held:
        yield held


def indexes(documents: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """One index per block of the benchmark, built when asked for, and whether it is the last."""
    some = blocks(benchmark)
    now = next(some, None)
    if now is None:
        return
    n_passages, seen = _passage_counts(documents)
    while now is not None and n_passages:
        next_ = next(some, None)
        yield build(documents, now, n_passages, seen), next_ is None
        now = next_


def _hits(documents: DataFrame, index: Index | None) -> DataFrame:
    """key, doc_id, item_id, cosine, found, answer of the items of one index; without one no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(index) if index else None
        for batch, texts in pieces(batches) if finder else ():
            hits = finder.find(texts)
            rows = pa.array([h[0] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(rows), batch.column("doc_id").take(rows), pa.array([h[1] for h in hits], pa.int64()), *[pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4)]],
                ["key", "doc_id", "item_id", "cosine", "found", "answer"],
            )

    rows = documents.select(row_name().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), folded().alias("text"))
    return rows.mapInArrow(run, "key binary, doc_id long, item_id long, cosine double, found double, answer double")


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Returns doc_id, item_id, cosine, found, answer: one row for each document and item it holds.

    Clean documents have no row, nor have null and empty texts; items without words are never found. Items without an id
    are searched like the others and reported together under a null item_id. A repeated
    row is reported as often as it occurs. Empty tables give no rows. Other columns are ignored.

    Each block of a larger benchmark takes a pass over the documents; only its index is held meanwhile.
    """
    columns = ["doc_id", "item_id", "cosine", "found", "answer"]
    told, same = None, ["key", "doc_id", "item_id"]
    for k, (index, last) in enumerate(indexes(documents, benchmark)):
        hits = _hits(documents, index)
        if told is None and last:
            return hits.select(columns)
        # Pieces of one item may be in two blocks: the larger share counts, of equal ones the first.
        best = F.struct("found", F.lit(-k).alias("block"), "cosine", "answer")
        hits = hits.groupBy(same).agg(F.count("*").alias("n"), F.max(best).alias("best"))
        both = hits if told is None else told.unionByName(hits).groupBy(same).agg(F.max("n").alias("n"), F.max("best").alias("best"))
        told = materialize(both, "block-hits")
    if told is None:
        return _hits(documents, None).select(columns)
    return told.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("doc_id", "item_id", "best.cosine", "best.found", "best.answer")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item.

    Only texts go through Python, and only names of rows come back; the rows themselves are dropped by name in the JVM.
    Rows that repeat an id and text share their name, and hold the same items.
    """
    key, told = unused(documents, "_key"), None
    for index, _ in indexes(documents, benchmark):
        hits = _hits(documents, index).select(F.col("key").alias(key))
        told = materialize((hits if told is None else told.union(hits)).distinct(), "block-keys")
    return documents if told is None else drop_keys(documents.withColumn(key, row_name()), told, key).select(documents.columns)
