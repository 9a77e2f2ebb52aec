"""Jaccard join of word-shingle sets with signature trees.

Links are all pairs of documents whose sets of five-word shingles have a similarity of 0.75 or more. Two linked sets
share a shingle among the first n - ceil(0.75 n) + 1 of each in any common order, so sets meet only in the
buckets of these shingles (frequent shingles come last in the order, to keep buckets small). Equal sets are one
class from the start.

1. In every bucket each class is compared with the bucket's lowest class. Whoever links with it needs no further
   comparison with others that do: all of them are in one component. Families of near copies end here. In buckets
   where someone did not link, a few turns repeat this with two other centres each, against other components only.
2. Buckets that still hold several components become forests of signature trees: blocks of similar size, in
   them nodes holding OR- and AND-combined shingle bitmaps and size ranges. A dual traversal of two blocks drops node
   pairs whose largest possible overlap is too small, and pairs known to be in one component; what is left
   is compared set by set.
3. Components of all links found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Hasher, Texts, drop_keys, keep_keys, pieces, row_key, unused, words
from cadenza.llm.common import mix as scramble
from cadenza.llm.components import components
from cadenza.session import materialize

SHINGLE = 5
#: Bits of a signature for each shingle of the largest set of its band; bands of sizes grow by 4/3.
BITS_EACH = 8
#: Most bits of the signature that a bucket carries; the pairs that trees find are tested on the whole signatures.
SKETCH = 2048
#: Classes of one block, children of one tree node.
BLOCK, FANOUT = 256, 8
#: Turns with new centres before the trees. They only save the trees work; any number gives the same components.
TURNS = 3
#: One document in so many is looked at to guess which shingles are frequent, and so many are remembered. This only
#: orders shingles; any order gives the same links.
GUESS_EVERY, GUESS_KEEP = 16, 100_000


def shingles(texts: Texts, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted by text and hash, and where each text begins (and the end)."""
    starts, ends = words(texts)
    hashes = hasher.stretches(hasher.sums(texts.data), starts, ends)
    owner = texts.owner(starts)
    n_words = np.bincount(owner, minlength=texts.n)
    if len(hashes) >= SHINGLE:
        whole = hashes[: len(hashes) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            whole = scramble(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - SHINGLE + 1 + k])
        inside = owner[: len(whole)] == owner[SHINGLE - 1 :]
        who, value = owner[: len(whole)][inside], whole[inside]
    else:
        who, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(few):
        first = (np.cumsum(n_words) - n_words)[few]
        short = np.full(len(few), 77, np.uint64)
        for k in range(SHINGLE - 1):
            has = n_words[few] > k
            short[has] = scramble(short[has] * np.uint64(0x9E3779B97F4A7C15) + hashes[first[has] + k])
        who, value = np.concatenate([who, few]), np.concatenate([value, scramble(short + n_words[few].astype(np.uint64))])
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(who[order], kind="stable")]
    who, value = who[order], value[order]
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (value[1:] != value[:-1])
    who, value = who[fresh], value[fresh]
    return value, np.searchsorted(who, np.arange(texts.n + 1))


def _classes(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit digest per set, for equal sets the same."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(scramble(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    return scramble(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def required(n: np.ndarray) -> np.ndarray:
    """Fewest shingles that a set of n shares with any set it links with."""
    return (3 * n + 3) // 4


def _prefixes(value: np.ndarray, at: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set its first n - required(n) + 1 shingles: rare ones first, then by hash."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    late = np.zeros(len(value), bool)
    if len(frequent) and len(value):
        place = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
        late = frequent[place] == value
    order = np.argsort(owner * 2 + late, kind="stable")
    rank = np.arange(len(value)) - np.repeat(at[:-1], n)
    keep = rank < np.repeat(np.where(n > 0, n - required(n) + 1, 0), n)
    return value[order][keep], np.concatenate([[0], np.cumsum(np.where(n > 0, n - required(n) + 1, 0))])


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def bands(n: np.ndarray) -> np.ndarray:
    """Size bands: linked sets are in one band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3) + 1e-9).astype(np.int64)


def _widths(n: np.ndarray) -> np.ndarray:
    """Signature bits by band: a power of two, 64 at least."""
    largest = (4 / 3) ** (bands(n) + 1)
    return 1 << np.maximum(6, np.ceil(np.log2(BITS_EACH * largest))).astype(np.int64)


def _bitmap(value: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width, np.uint8)
    bits[(value % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _signatures(value: np.ndarray, at: np.ndarray, wanted: np.ndarray, most: int = 1 << 62) -> pa.Array:
    """Bitmaps of the sets' shingles, of ``most`` bits at most; null where not wanted."""
    widths = np.minimum(_widths(np.diff(at)), most).tolist()
    return pa.array([_bitmap(value[a:b], w) if want else None for a, b, w, want in zip(at[:-1], at[1:], widths, wanted)], pa.binary())


def _folded(sigs: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of fewer bits: halves laid over each other."""
    while sigs.shape[1] > width:
        half = sigs.shape[1] // 2
        sigs = sigs[:, :half] | sigs[:, half:]
    return sigs


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), -1)


def _frequent(documents: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for _, texts in pieces(batches):
            value, _ = shingles(texts, hasher)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64))], ["token"])

    some = documents.where(F.pmod(row_key(), F.lit(GUESS_EVERY)) == 0).select("text")
    counts = some.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n >= 4")
    top = counts.orderBy(F.desc("n"), "token").limit(GUESS_KEEP).select("token").toPandas()
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def _sets(documents: DataFrame, frequent: np.ndarray) -> DataFrame:
    """One row per document: doc_id, key, n, class, prefix, sig, sketch. A class seen before in the same piece has no prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch, texts in pieces(batches):
            value, at = shingles(texts, hasher)
            n, cls = np.diff(at), _classes(value, at)
            prefix, cut = _prefixes(value, at, frequent)
            first = np.zeros(texts.n, bool)
            first[np.unique(cls, return_index=True)[1]] = True
            held = np.repeat(first, np.diff(cut))
            cut = np.concatenate([[0], np.cumsum(np.where(first, np.diff(cut), 0))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n), pa.array(cls, mask=n == 0), _lists(prefix[held], cut),
                 _signatures(value, at, first), _signatures(value, at, first, SKETCH)],
                ["doc_id", "key", "n", "cls", "prefix", "sig", "sketch"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, n long, cls long, prefix array<long>, sig binary, sketch binary")


def _stars(tokens: DataFrame) -> DataFrame:
    """In each bucket with two classes or more: token, the lowest class as centre, and every other class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the batch before: token, class, and the centre of its bucket
        for batch in batches:
            token, cls, n = (batch.column(c).to_numpy() for c in ("token", "cls", "n"))
            if not len(token):
                continue
            fresh = np.ones(len(token), bool)
            fresh[1:] = token[1:] != token[:-1]
            repeated = np.zeros(len(token), bool)
            repeated[1:] = ~fresh[1:] & (cls[1:] == cls[:-1])
            goes_on = held is not None and token[0] == held[0]
            if goes_on:
                fresh[0] = False
                repeated[0] = cls[0] == held[1]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(token)), -1))
            centre, centre_n = cls[begin].copy(), n[begin].copy()
            if goes_on:
                centre[begin < 0], centre_n[begin < 0] = held[2], held[3]
            held = token[-1], cls[-1], centre[-1], centre_n[-1]
            out = ~fresh & ~repeated
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[out]) for x in (token, centre, centre_n, cls, n)], ["token", "centre", "centre_n", "cls", "n"]
            )

    ordered = tokens.repartition("token").sortWithinPartitions("token", "cls")
    return ordered.mapInArrow(run, "token long, centre long, centre_n long, cls long, n long")


def _whole_sets(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """cls, n and all shingles of the documents named by ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for _, texts in pieces(batches):
            value, at = shingles(texts, hasher)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_classes(value, at)), pa.array(np.diff(at)), _lists(value, at)], ["cls", "n", "tokens"]
            )

    rows = keep_keys(documents.select(row_key().alias("key"), "text"), keys, "key")
    return rows.select("text").mapInArrow(run, "cls long, n long, tokens array<long>")


def _same_widths(a: list[int], b: list[int]) -> list[np.ndarray]:
    """Rows by their two signature widths."""
    both = np.array(a, np.int64) << 32 | np.array(b, np.int64)
    return [np.flatnonzero(both == x) for x in np.unique(both)]


def _may_pair(sig_a: np.ndarray, n_a: np.ndarray, sig_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """may_link for sets in line, components unknown."""
    width, i = min(sig_a.shape[1], sig_b.shape[1]), np.arange(len(n_a))
    a, b = _folded(sig_a, width), _folded(sig_b, width)
    return may_link((a, a, n_a, n_a, i, i), i, (b, b, n_b, n_b, i + len(i), i + len(i)), i)


def _touched(pairs: DataFrame) -> DataFrame:
    """The classes in pairs that are already written, each once."""
    return materialize(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "tree-touched")


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b: classes; already written) that sizes and bitmaps do not rule out. Only bitmaps in question are moved."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            sig_a, sig_b = batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist()
            keep = np.zeros(len(batch), bool)
            for rows in _same_widths([len(x) for x in sig_a], [len(x) for x in sig_b]):
                keep[rows] = _may_pair(_matrix([sig_a[i] for i in rows]), n_a[rows], _matrix([sig_b[i] for i in rows]), n_b[rows])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    few = keep_keys(classes.select("cls", "n", "sig"), _touched(pairs), "cls")
    one = few.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = few.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(test, "a long, b long")


def _linked(pairs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs (a, b: classes) whose sets have 4 * intersection >= 3 * union, counted shingle by shingle."""
    pairs = materialize(pairs, "tree-asked")
    keys = materialize(keep_keys(classes.select("cls", "key"), _touched(pairs), "cls").select("key"), "tree-keys")
    sets = materialize(_whole_sets(documents, keys).dropDuplicates(["cls"]), "tree-whole")
    one = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    two = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(one, "b").join(two, "a").withColumn("_common", common).where(
        4 * F.col("_common") >= 3 * (F.col("n_a") + F.col("n_b") - F.col("_common"))
    ).select("a", "b")


def _distinct_buckets(stars: DataFrame) -> DataFrame:
    """Rows of one bucket among all with the same classes: its pairs are theirs."""
    same = ["centre", "m", "x", "y"]
    buckets = stars.groupBy("token", "centre").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")
    )
    return stars.join(buckets.groupBy(*same).agg(F.min("token").alias("token")).select("token"), "token", "left_semi")


class Tree:
    """Signature tree over one block: level 0 are the sets, each node above combines up to FANOUT nodes."""

    def __init__(self, n: np.ndarray, sigs: np.ndarray, comp: np.ndarray):
        self.levels = [(sigs, sigs, n, n, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            or_, and_, low, high, first, last = self.levels[-1]
            at = np.arange(0, len(or_), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(or_, at), np.bitwise_and.reduceat(and_, at), np.minimum.reduceat(low, at),
                np.maximum.reduceat(high, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at),
            ))


def may_link(left: tuple, i: np.ndarray, right: tuple, j: np.ndarray) -> np.ndarray:
    """Whether two nodes can hold a link: their largest possible overlap against the smallest required one.

    A bit that every set of one node has and no set of the other is a shingle that they do not share.
    """
    or_a, and_a, low_a, high_a, first_a, last_a = (x[i] for x in left)
    or_b, and_b, low_b, high_b, first_b, last_b = (x[j] for x in right)
    only_a = np.bitwise_count(and_a & ~or_b).sum(axis=1).astype(np.int64)
    only_b = np.bitwise_count(and_b & ~or_a).sum(axis=1).astype(np.int64)
    most = np.minimum(high_a - only_a, high_b - only_b)
    need = np.maximum(required(np.maximum(low_a, low_b)), -(-3 * (low_a + low_b) // 7))
    one_component = (first_a == last_a) & (first_b == last_b) & (first_a == first_b)
    return (most >= need) & ~one_component


def dual_traversal(a: Tree, b: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that no bound rules out; within one tree each pair once."""
    up_a, up_b = len(a.levels) - 1, len(b.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        keep = may_link(a.levels[up_a], i, b.levels[up_b], j)
        if same and up_a == up_b:
            keep &= (i < j) if up_a == 0 else (i <= j)
        i, j = i[keep], j[keep]
        if not len(i) or up_a == up_b == 0:
            return i, j
        if up_a >= up_b and up_a > 0:  # both trees of one block go down together
            up_a -= 1
            i, j = _children(i, j, len(a.levels[up_a][0]))
        if up_b > up_a or (same and up_b > 0):
            up_b -= 1
            j, i = _children(j, i, len(b.levels[up_b][0]))


def _children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    kids = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    other = np.repeat(j, FANOUT)
    return kids[kids < n], other[kids < n]


def _tree_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs from members (token, cls, n, comp; already written) of buckets.

    A bucket of at most BLOCK sets is one row. A larger one is dealt into blocks of one size band each, and block meets
    block, so that no task holds a whole large bucket.
    """
    sketched = materialize(members.select("cls").distinct(), "tree-touched")
    sig = keep_keys(classes.select("cls", F.col("sketch").alias("sig")), sketched, "cls")
    one = F.struct("n", "cls", "comp", "sig")
    sizes = members.groupBy("token").agg(F.count("*").alias("m"))
    small = members.join(sizes.where(F.col("m") <= BLOCK).select("token"), "token", "left_semi").join(sig, "cls")
    whole = small.groupBy("token").agg(F.collect_list(one).alias("sets_a"))
    found = whole.select("sets_a").mapInArrow(_each(_walk_bucket), "a long, b long")
    large = materialize(sizes.where(F.col("m") > BLOCK).select("token"), "tree-large")
    if not large.isEmpty():
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4.0 / 3.0)) + F.lit(1e-9)).cast("long")
        dealt = members.join(large, "token", "left_semi").withColumn("band", band)
        counts = dealt.groupBy("token", "band").agg(F.count("*").alias("m"))
        dealt = dealt.join(counts, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), 1 + F.floor(F.col("m") / BLOCK)))
        blocks = dealt.join(sig, "cls").groupBy("token", "band", "block").agg(F.collect_list(one).alias("sets"), F.min("comp").alias("first"), F.max("comp").alias("last"))
        blocks = materialize(blocks, "tree-blocks")
        left = blocks.select("token", "band", *[F.col(c).alias(f"{c}_a") for c in ("block", "sets", "first", "last")])
        # Sets of linked sizes are in one band or in neighbouring ones.
        right = blocks.withColumn("met", F.explode(F.array(F.col("band"), F.col("band") - 1)))
        right = right.select("token", F.col("met").alias("band"), F.col("band").alias("band_b"), *[F.col(c).alias(f"{c}_b") for c in ("block", "sets", "first", "last")])
        settled = (F.col("first_a") == F.col("last_a")) & (F.col("first_b") == F.col("last_b")) & (F.col("first_a") == F.col("first_b"))
        met = left.join(right, ["token", "band"]).where(((F.col("band") != F.col("band_b")) | (F.col("block_a") <= F.col("block_b"))) & ~settled)
        same = (F.col("band") == F.col("band_b")) & (F.col("block_a") == F.col("block_b"))
        found = found.union(met.select("sets_a", "sets_b", same.alias("same")).mapInArrow(_each(_walk_blocks), "a long, b long"))
    return found.distinct()


def _each(fn: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> Callable:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                x, y = fn(batch.slice(at, 2048))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return walk


class Sets:
    """Sets of a batch of lists, laid out flat; list ``k`` is ``at[k]:at[k] + length[k]``."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        self.n, self.cls, self.comp = (flat.field(c).to_numpy() for c in ("n", "cls", "comp"))
        self.sig = flat.field("sig").to_pylist()
        self.length = column.value_lengths().to_numpy()
        self.at = np.cumsum(self.length) - self.length

    def tree(self, rows: np.ndarray, width: int) -> tuple[Tree, np.ndarray]:
        rows = rows[np.lexsort((self.cls[rows], self.n[rows]))]
        return Tree(self.n[rows], _folded(_matrix([self.sig[i] for i in rows]), width), self.comp[rows]), self.cls[rows]

    def width(self, rows: np.ndarray) -> int:
        return min(len(self.sig[i]) for i in rows) // 8


def _join(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *[f[q] for f in found]]) for q in (0, 1))


def _meet(a: Sets, rows_a: np.ndarray, b: Sets, rows_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    width = min(a.width(rows_a), b.width(rows_b))
    (one, cls_a), (two, cls_b) = a.tree(rows_a, width), b.tree(rows_b, width)
    x, y = dual_traversal(one, two, same)
    return cls_a[x], cls_b[y]


def _walk_blocks(met: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    a, b = Sets(met.column("sets_a")), Sets(met.column("sets_b"))
    same = met.column("same").to_pylist()
    return _join([_meet(a, a.at[k] + np.arange(a.length[k]), b, b.at[k] + np.arange(b.length[k]), same[k]) for k in range(len(met))])


def _walk_bucket(whole: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Whole buckets. Those that fit one tree node are tested together, larger ones walk a tree per size band."""
    s, found = Sets(whole.column("sets_a")), []
    few = np.flatnonzero(s.length <= 2 * FANOUT)
    count = s.length[few] ** 2
    block = np.repeat(few, count)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    i, j = s.at[block] + nth // s.length[block], s.at[block] + nth % s.length[block]
    fits = (i < j) & (s.comp[i] != s.comp[j]) & (4 * np.minimum(s.n[i], s.n[j]) >= 3 * np.maximum(s.n[i], s.n[j]))
    i, j = i[fits], j[fits]
    _, first = np.unique(np.stack([s.cls[i], s.cls[j]], axis=1), axis=0, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
    i, j = i[first], j[first]
    for rows in _same_widths([len(s.sig[x]) for x in i], [len(s.sig[x]) for x in j]):
        for at in range(0, len(rows), 4096):
            p, q = i[rows[at : at + 4096]], j[rows[at : at + 4096]]
            ok = _may_pair(_matrix([s.sig[x] for x in p]), s.n[p], _matrix([s.sig[x] for x in q]), s.n[q])
            found.append((s.cls[p[ok]], s.cls[q[ok]]))
    for k in np.flatnonzero(s.length > 2 * FANOUT):
        rows = s.at[k] + np.arange(s.length[k])
        band = bands(s.n[rows])
        for low in np.unique(band):
            own, next_ = rows[band == low], rows[band == low + 1]
            found.append(_meet(s, own, s, own, True))
            if len(next_):
                found.append(_meet(s, own, s, next_, False))
    return _join(found)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (token, cls, n) with their component, of buckets that hold more than one."""
    told = members.join(roots.select(F.col("node").alias("cls"), F.col("root").alias("comp")), "cls")
    several = told.groupBy("token").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first != last")
    return materialize(told.join(several.select("token"), "token", "left_semi"), "tree-open-members")


def _centred(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's two centres of a turn with the classes of other components, sizes permitting.

    The centres are those with the smallest and the largest hash, so that buckets of the same classes agree on them.
    """
    one = F.struct(F.xxhash64("cls", F.lit(turn)).alias("hash"), "cls", "n", "comp")
    centres = members.groupBy("token").agg(F.array(F.min(one), F.max(one)).alias("centres"))
    met = members.join(centres, "token").withColumn("c", F.explode("centres"))
    sizes = 4 * F.least("n", "c.n") >= 3 * F.greatest("n", "c.n")
    return met.where((F.col("comp") != F.col("c.comp")) & sizes).select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots (node, root) once links between the nodes are added; only links between components count."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    between = links.join(a, "a").join(b, "b").where("root_a != root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    up = components(between.distinct()).select(F.col("node").alias("root"), F.col("root").alias("up"))
    return materialize(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "tree-merged")


def join(documents: DataFrame) -> DataFrame:
    """Returns doc_id, n_shingles, component_id, one row per input row.

    Null, empty and blank texts have 0 shingles and are linked with nothing; their component is their own id. Rows
    with equal sets are one class, whatever their ids; a null id counts only where all ids of a component are
    null. An empty table gives no rows. Other columns are ignored.
    """
    return _joined(documents).select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, less all but one of each component.

    The smallest doc_id stays (a null one only where there is no other). Of rows that repeat both id and text
    one stays. Texts without words stay, all of them.
    """
    rows = _joined(documents, names=True).where("n_shingles > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    stays = rows.groupBy("root").agg(best.alias("best"))
    told = rows.select("root", "key").distinct().join(stays, "root")
    name = unused(documents, "_key")
    losers = materialize(told.where(F.col("key") != F.col("best.key")).select(F.col("key").alias(name)).distinct(), "tree-losers")
    repeated = materialize(rows.groupBy(F.col("key").alias(name)).agg(F.count("*").alias("n")).where("n > 1").select(name), "tree-repeated")
    kept = drop_keys(documents.withColumn(name, row_key()), losers, name)
    if not repeated.isEmpty():
        kept = drop_keys(kept, repeated, name).unionByName(keep_keys(kept, repeated, name).dropDuplicates([name]))
    return kept.select(documents.columns)


def _joined(documents: DataFrame, names: bool = False) -> DataFrame:
    """join, with key and root too where ``names`` is set."""
    docs = materialize(_sets(documents, _frequent(documents)), "tree-sets")
    classes = docs.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min("key").alias("key"), F.max("n").alias("n"), F.first("sig", ignorenulls=True).alias("sig"),
        F.first("sketch", ignorenulls=True).alias("sketch"),
    )
    classes = materialize(classes, "tree-classes")
    tokens = docs.where(F.size("prefix") > 0).select(F.explode("prefix").alias("token"), "cls", "n")
    stars = materialize(_stars(tokens), "tree-stars")
    small, large = F.least("n", "centre_n"), F.greatest("n", "centre_n")
    pairs = stars.groupBy(F.col("centre").alias("a"), F.col("cls").alias("b")).agg(F.max((4 * small >= 3 * large).cast("int")).alias("fits"))
    pairs = materialize(pairs, "tree-pairs")
    first = materialize(_linked(_possible(pairs.where("fits = 1").select("a", "b"), classes), classes, documents), "tree-links")
    roots = components(first)
    unlinked = pairs.select("a", "b").exceptAll(first)
    if not unlinked.isEmpty():
        loose = stars.join(unlinked.select(F.col("a").alias("centre"), F.col("b").alias("cls")), ["centre", "cls"], "left_semi").select("token").distinct()
        open_ = materialize(_distinct_buckets(stars.join(loose, "token", "left_semi")), "tree-open")
        members = open_.select("token", "cls").union(open_.select("token", F.col("centre").alias("cls"))).distinct()
        members = materialize(members.join(classes.select("cls", "n"), "cls"), "tree-members")
        single = members.select(F.col("cls").alias("node")).distinct()
        roots = materialize(single.join(roots, "node", "full").select("node", F.coalesce("root", "node").alias("root")), "tree-merged")
        tested = pairs.select("a", "b")
        for turn in range(TURNS):
            asked = materialize(_centred(_open(members, roots), turn).join(tested, ["a", "b"], "left_anti"), "tree-turn")
            if asked.isEmpty():
                break
            tested = tested.union(asked)
            roots = _merged(roots, materialize(_linked(_possible(asked, classes), classes, documents), "tree-links"))
        asked = materialize(_tree_pairs(_open(members, roots), classes).join(tested, ["a", "b"], "left_anti"), "tree-found")
        more = _linked(_possible(asked, classes), classes, documents)
        roots = _merged(roots, materialize(more, "tree-more"))
    named = classes.select("cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    named = materialize(named.select("cls", "least", F.coalesce("root", "cls").alias("root")), "tree-roots")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(lowest, "root").select("cls", "component_id", *["root"] * names)
    return docs.select("doc_id", "n", "cls", *["key"] * names).join(answer, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *["key", "root"] * names,
    )
