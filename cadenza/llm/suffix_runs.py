"""Removal of repeated 50-byte strings by a distributed merge sort of suffixes that knows common prefixes.

Suffixes are taken at anchors: of each WIDTH-byte window the place of its smallest K-byte hash. Equal windows have their
anchor at the same place, so a window can only recur where its anchor's K bytes do. All windows with one anchor lie in
one stretch of text, the anchor's span.

1. Spans meet by their anchor's hash; those of an anchor that a sample shows to be crowded meet by anchor and side, a
   side being the bytes around the anchor that a group of windows has in common. A span that a smaller document holds
   whole is settled. Where only the anchor and a side recur, the span is open on that side. Tasks settle what they
   hold themselves first, and send each span once, of a crowded anchor once per side.
2. Open spans are exchanged by anchor and side, as runs: suffixes from the side on, cut to the windows of its group,
   sorted and front-coded (the length of the prefix shared with the suffix before, then the rest). Of a side with very
   many spans the windows are exchanged one by one. A loser tree merges the runs of all tasks; it compares two suffixes
   only from the first byte on that is not known to be equal, and hands on the length of the common prefix.
   Neighbours with SIDE bytes in common may have the same side; their windows are compared there.
3. Each document's settled stretches are cut out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Hasher, Texts, keep_keys, mix, pieces, row_key, store_packed, text_or_empty
from cadenza.session import materialize

WIDTH, K = 50, 20
#: Windows of one anchor by how many bytes of them lie left of it, in groups (least, most). The windows of a group share
#: the bytes from ``least`` left of the anchor to the end of the window that begins ``most`` left of it.
GROUPS = [(a, min(a + 7, WIDTH - K)) for a in range(0, WIDTH - K + 1, 8)]
#: Bytes that all windows of a group share, at least.
SIDE = min(WIDTH - most + least for least, most in GROUPS)
#: Distinct spans from which on an anchor's spans are dealt by their sides, and a side's windows one by one.
CROWDED, WIDE = 100_000, 20_000
#: One document in so many is looked at for crowded anchors, and the least spans of such an anchor that a task reports.
SAMPLE, REPORTED = 16, 4
#: Bytes of text whose anchors one part of an exchange takes, on average.
PART_BYTES = 8 << 20
#: Anchors, and open spans, that a task holds before it sends them.
HELD, HELD_OPEN = 300_000, 100_000
#: Kinds of an answer: held whole by a smaller id; open, for larger ids to compare with; open, for a smaller id.
SETTLED, OPEN, TARGET = 0, 1, 2
_LOW = np.uint64((1 << 48) - 1)
_MARK_BITS = np.uint64(2 + 2 * len(GROUPS))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Anchors:
    """Anchors of all texts: place ``p``, first and last window start, text, hashes of the K bytes, the span and the sides."""

    def __init__(self, texts: Texts, hasher: Hasher):
        n = len(texts.data)
        sums = hasher.sums(texts.data)
        hashes = hasher.every(sums, K)
        empty = np.zeros(0, np.int64)
        self.lo = self.hi = self.p = self.owner = empty
        if n >= WIDTH:
            low = np.uint64((1 << max(20, n.bit_length())) - 1)
            # The place in the low bits: among equal hashes the leftmost counts, in every copy the same.
            best = _lowest((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), WIDTH - K + 1)
            at = (best & low).astype(np.int64)
            inside = np.ones(len(at) + WIDTH, bool)
            inside[np.maximum(texts.at[1:, None] - np.arange(1, WIDTH), 0).ravel()] = False
            short = np.flatnonzero(np.diff(texts.at) < WIDTH)
            for i in short:
                inside[texts.at[i] : texts.at[i + 1]] = False
            start = np.flatnonzero(inside[: len(at)])
            if len(start):
                at = at[start]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
                first = np.flatnonzero(new)
                self.lo, self.p = start[first], at[first]
                self.hi = start[np.append(first[1:], len(start)) - 1]
                self.owner = texts.owner(self.lo)
        self.anchor = (hashes[self.p] >> np.uint64(16)) & _LOW if len(self.p) else np.zeros(0, np.uint64)
        self.span = hasher.stretches(sums, self.lo, self.hi + WIDTH) >> np.uint64(16)
        # Three bytes per group: 0 where no window is of the group, else a hash of what its windows share.
        self.sides = np.zeros((len(self.p), len(GROUPS)), np.uint32)
        for g, (least, most) in enumerate(GROUPS):
            has = np.flatnonzero((self.lo <= self.p - least) & (self.hi >= self.p - most))
            shared = hasher.stretches(sums, self.p[has] - least, self.p[has] - most + WIDTH)
            self.sides[has, g] = 1 + shared % np.uint64((1 << 24) - 1)


def _six(values: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _pack_sides(sides: np.ndarray) -> bytes:
    """A byte per row that says which sides it has, then those in three bytes each."""
    has = sides > 0
    some = sides[has].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return np.packbits(has, axis=1, bitorder="little").tobytes() + some.tobytes()


def _unpack_sides(blob: bytes, n: int) -> np.ndarray:
    has = np.unpackbits(np.frombuffer(blob[:n], np.uint8)[:, None], axis=1, count=len(GROUPS), bitorder="little").astype(bool)
    raw = np.zeros((int(has.sum()), 4), np.uint8)
    raw[:, :3] = np.frombuffer(blob[n:], np.uint8).reshape(-1, 3)
    sides = np.zeros(has.shape, np.uint32)
    sides[has] = raw.view("<u4").ravel()
    return sides


def _dealt(anchor: np.ndarray, sides: np.ndarray, g: int, n_parts: int) -> np.ndarray:
    """The part where spans with this anchor and this side of group ``g`` meet."""
    return (mix(anchor ^ mix(sides[:, g].astype(np.uint64) << np.uint64(8) | np.uint64(g))) % np.uint64(n_parts)).astype(np.int64)


def _gaps(ids: np.ndarray) -> bytes:
    """Ascending ids: the first, then the gaps, in as few bytes each as the widest gap needs."""
    gaps = np.diff(ids.view(np.uint64))
    kind = np.min_scalar_type(gaps.max()) if len(gaps) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + ids[:1].tobytes() + gaps.astype(kind).tobytes()


def _ungaps(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(blob[9:], f"<u{blob[0]}").astype(np.uint64)
    first = np.frombuffer(blob[1:9], np.uint64)
    return np.cumsum(np.concatenate([first, gaps]), dtype=np.uint64).view(np.int64)


def _settled(anchor: np.ndarray, span: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by anchor, span, id; in that order the number of the equal span, and whether a smaller id holds it."""
    order = np.lexsort((ids, span, anchor))
    a, s, i = anchor[order], span[order], ids[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    return order, group, i > i[np.flatnonzero(new)][group] if len(a) else np.zeros(0, bool)


def _by_id(ids: np.ndarray, spans: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(ids, kind="stable")
    ids, spans = ids[order], spans[order]
    cut = np.append(np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if len(ids) else 0)), len(ids))
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(ids[a]), _six(np.unique(spans[a:b]))


_SENT = "part int, id long, anchor binary, span binary, sides binary, doc binary, ids binary"


def _crowded(documents: DataFrame, sample: int, least: int) -> np.ndarray:
    """Anchors with about ``least`` distinct spans or more, judged by one document in ``sample``. Only the dealing depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts() -> pa.RecordBatch:
            anchor, span = (np.concatenate(x) for x in zip(*held))
            some, n = np.unique(anchor[np.unique(span, return_index=True)[1]], return_counts=True)
            some, n = some[n >= REPORTED], n[n >= REPORTED]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(n)], ["anchor", "n"])

        hasher, held, count = Hasher(), [], 0
        for _, texts in pieces(batches):
            a = Anchors(texts, hasher)
            held.append((a.anchor, a.span))
            count += len(a.p)
            if count >= HELD:
                yield counts()
                held, count = [], 0
        if held:
            yield counts()

    some = documents.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(sample)) == 0).select("text")
    found = some.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") * sample >= least)
    return np.array(sorted(row["anchor"] for row in found.collect()), np.uint64)


def _send_spans(documents: DataFrame, n_parts: int, crowded: np.ndarray) -> DataFrame:
    """Rows for the exchange by anchor, or by anchor and side; rows with an id are spans already settled inside a task."""

    def rows(held: list[tuple]) -> pa.RecordBatch:
        out: dict[str, list] = {c.split()[0]: [] for c in _SENT.split(", ")}
        anchor, span, sides, ids = (np.concatenate(x) for x in zip(*held))
        order, _, settled = _settled(anchor, span, ids)
        anchor, span, sides, ids = (x[order] for x in (anchor, span, sides, ids))
        for one, blob in _by_id(ids[settled], span[settled]):
            for name, value in zip(out, (hash(one) % n_parts, one, None, blob, None, None, None)):
                out[name].append(value)
        anchor, span, sides, ids = (x[~settled] for x in (anchor, span, sides, ids))
        part = (anchor % np.uint64(n_parts)).astype(np.int64)
        hot = np.isin(anchor, crowded)
        if hot.any():
            # Once per side, with that side alone: equal spans and equal sides still meet.
            parts, picked, alone = [part[~hot]], [np.flatnonzero(~hot)], [sides[~hot]]
            for g in range(len(GROUPS)):
                has = np.flatnonzero(hot & (sides[:, g] > 0))
                parts.append(_dealt(anchor[has], sides[has], g, n_parts))
                picked.append(has)
                alone.append(np.where(np.arange(len(GROUPS)) == g, sides[has], 0).astype(np.uint32))
            part, picked, sides = np.concatenate(parts), np.concatenate(picked), np.concatenate(alone)
            anchor, span, ids = anchor[picked], span[picked], ids[picked]
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(n_parts + 1))
        for i in range(n_parts):
            r = order[cut[i] : cut[i + 1]]
            if len(r):
                some, doc = np.unique(ids[r], return_inverse=True)
                values = (i, None, _six(anchor[r]), _six(span[r]), _pack_sides(sides[r]), doc.astype(np.uint32 if len(some) > 65535 else np.uint16).tobytes(), _gaps(some))
                for name, value in zip(out, values):
                    out[name].append(value)
        types = {"part": pa.int32(), "id": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.binary())) for c, v in out.items()], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, count, seen = Hasher(), [], 0, {}
        for batch, texts in pieces(batches):
            ids = batch.column("id").to_numpy()
            a = Anchors(texts, hasher)
            copy = np.zeros(texts.n, bool)  # the text came by with an id no larger
            for i, (one, same) in enumerate(zip(ids.tolist(), batch.column("same").to_pylist())):
                copy[i] = seen.get(same, one + 1) <= one
                if not copy[i]:
                    seen[same] = one
            keep = ~copy[a.owner]
            held.append((a.anchor[keep], a.span[keep], a.sides[keep], ids[a.owner[keep]]))
            count += int(keep.sum())
            if count >= HELD:
                yield rows(held)
                held, count, seen = [], 0, {}
        if count:
            yield rows(held)

    return documents.select("id", F.xxhash64("text").alias("same"), "text").mapInArrow(run, _SENT)


def _one_part_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each part in turn: a task may get several parts, sorted, but holds one."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if end == start:
                continue
            if held and part[start] != now:
                yield held
                held = []
            now = part[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield held


def _answer_spans(sent: DataFrame, wide: int) -> DataFrame:
    """For each id the spans that a smaller id holds whole, and the open spans.

    One number: the hash in 48 bits, a bit per group that is to go window by window, a bit per open group, the kind.
    """

    names = ["id", "mark"]

    def answer(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in batch.filter(batch.column("id").is_valid()).select(["id", "span"]).to_pylist():
                marks = _unsix(row["span"]) << _MARK_BITS
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(marks), row["id"])), pa.array(marks.astype(np.int64))], names)
            for row in batch.filter(batch.column("id").is_null()).to_pylist():
                ids = _ungaps(row["ids"])
                doc = np.frombuffer(row["doc"], np.uint32 if len(ids) > 65535 else np.uint16)
                held.append((_unsix(row["anchor"]), _unsix(row["span"]), _unpack_sides(row["sides"], len(doc)), ids[doc]))
        if not held:
            return
        anchor, span, sides, ids = (np.concatenate(x) for x in zip(*held))
        del held
        order, group, settled = _settled(anchor, span, ids)
        anchor, span, sides, ids = (x[order] for x in (anchor, span, sides, ids))
        first = np.flatnonzero(~settled)
        open_, target = np.zeros(len(first), np.uint64), np.zeros(len(first), bool)
        for g, side in enumerate(sides.T):
            # The same bytes on this side of the same anchor, in different spans.
            has = np.flatnonzero(side[first] > 0)
            has = has[np.lexsort((group[first[has]], side[first[has]], anchor[first[has]]))]
            r = first[has]
            if not len(r):
                continue
            new = np.ones(len(r), bool)
            new[1:] = (anchor[r][1:] != anchor[r][:-1]) | (side[r][1:] != side[r][:-1])
            bundle = np.cumsum(new) - 1
            other = new.copy()
            other[1:] |= group[r][1:] != group[r][:-1]
            n_spans = np.bincount(bundle, other)[bundle]
            shared = n_spans >= 2
            open_[has] |= shared.astype(np.uint64) << np.uint64(2 + g)
            open_[has] |= (n_spans >= max(2, wide)).astype(np.uint64) << np.uint64(2 + len(GROUPS) + g)
            target[has] |= shared & (ids[r] > np.minimum.reduceat(ids[r], np.flatnonzero(new))[bundle])
        kind = np.where(target, TARGET, OPEN).astype(np.uint64)
        marks = np.concatenate([(span[settled] << _MARK_BITS) | np.uint64(SETTLED), (span[first] << _MARK_BITS | open_ | kind)[open_ > 0]])
        who = np.concatenate([ids[settled], ids[first[open_ > 0]]])
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(marks.astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _one_part_at_a_time(batches):
            yield from answer(part)

    answers = sent.repartition("part").sortWithinPartitions("part").mapInArrow(run, "id long, mark long")
    return answers.groupBy("id").agg(F.collect_set("mark").alias("marks"))


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings the length of the prefix shared with the one before, and the rest."""
    shared, rest, before = [], [], b""
    for s in strings:
        n, most = 0, min(len(s), len(before))
        while n < most and s[n] == before[n]:
            n += 1
        shared.append(n)
        rest.append(s[n:])
        before = s
    return shared, rest


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Merges front-coded sorted runs: (run, place in it, string, length of the prefix shared with the output before).

    A loser tree. Every contender carries the length of its common prefix with the last output. Of two, the one
    with the longer prefix is the smaller; only equal lengths need bytes, and only from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    now: list[bytes | None] = [None] * k
    place, known = [0] * k, [0] * k
    for i, (_, rest) in enumerate(runs):
        now[i] = rest[0] if rest else None

    def smaller(a: int, b: int) -> tuple[int, int]:
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        n, m = known[a], known[b]
        if n != m:
            return (a, b) if n > m else (b, a)
        most = min(len(x), len(y))
        while n < most and x[n] == y[n]:
            n += 1
        if n == most:
            first = len(x) <= len(y)
        else:
            first = x[n] < y[n]
        if first:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * k
    winners = list(range(k))
    level = k
    while level > 1:
        fresh = []
        for i in range(0, level, 2):
            win, lose = smaller(winners[i], winners[i + 1])
            losers[(level + i) // 2] = lose
            fresh.append(win)
        winners, level = fresh, level // 2
    top = winners[0]
    while now[top] is not None:
        string = now[top]
        yield top, place[top], string, known[top]
        place[top] += 1
        shared, rest = runs[top]
        if place[top] < len(rest):
            known[top] = shared[place[top]]
            now[top] = string[: known[top]] + rest[place[top]]
        else:
            now[top] = None
        node = (top + k) // 2
        while node >= 1:
            top, losers[node] = smaller(top, losers[node])
            node //= 2


_CUT = "kind int, part int, key long, text string, ranges binary, shared binary, rest binary, length binary, before binary, ids binary, keys binary, lo binary, at binary"


def _cut_spans(documents: DataFrame, n_parts: int) -> DataFrame:
    """Per document that may lose bytes (kind 0) its text and settled ranges; per part (kind 1) a front-coded run of open suffixes."""
    names = [c.split()[0] for c in _CUT.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        types = {"kind": pa.int32(), "part": pa.int32(), "key": pa.int64(), "text": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], types.get(c, pa.binary())) for c in names], names)

    def runs(open_: list[tuple]) -> pa.RecordBatch:
        parts: dict[int, list[tuple]] = {}
        for entry in open_:
            parts.setdefault(entry[0], []).append(entry[1:])
        rows = []
        for part, entries in parts.items():
            entries.sort(key=lambda e: e[0])
            shared, rest = front_code([e[0] for e in entries])
            rows.append({
                "kind": 1, "part": part, "shared": bytes(shared), "rest": b"".join(rest), "length": bytes(map(len, rest)),
                "before": b"".join(e[1] for e in entries), "at": bytes(len(e[1]) for e in entries),
                "ids": np.array([e[2] for e in entries], np.int64).tobytes(), "keys": np.array([e[3] for e in entries], np.int64).tobytes(),
                "lo": np.array([e[4] for e in entries], np.int64).tobytes(),
            })
        return batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, open_ = Hasher(), []
        bits = np.uint64(48)
        for whole in batches:
            for at in range(0, len(whole), 60_000):  # a row's number fits the 16 bits above a span
                for batch, texts in pieces(iter([whole.slice(at, 60_000)])):
                    a = Anchors(texts, hasher)
                    code = a.span | a.owner.astype(np.uint64) << bits
                    marks = batch.column("marks").flatten().to_numpy().astype(np.uint64)
                    row = np.repeat(np.arange(len(batch)), batch.column("marks").value_lengths().to_numpy())
                    kind, told = marks & np.uint64(3), marks >> _MARK_BITS | row.astype(np.uint64) << bits
                    settled = np.isin(code, told[kind == SETTLED])
                    loose = np.flatnonzero(np.isin(code, told[kind != SETTLED]) & ~settled)
                    # A crowded anchor's span has a mark per side.
                    order = np.argsort(told[kind != SETTLED], kind="stable")
                    known, start = np.unique(told[kind != SETTLED][order], return_index=True)
                    sides = np.bitwise_or.reduceat((marks[kind != SETTLED] >> np.uint64(2))[order], start) if len(start) else known
                    sides = sides[np.searchsorted(known, code[loose])]
                    target = np.bincount(row[kind != OPEN], minlength=len(batch)) > 0
                    depth = np.bincount(a.lo[settled], minlength=len(texts.data) + 1) - np.bincount(a.hi[settled] + WIDTH, minlength=len(texts.data) + 1)
                    covered = np.cumsum(depth) > 0
                    ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
                    rows = []
                    for i, text in enumerate(batch.column("text").to_pylist()):
                        if not target[i]:
                            continue
                        begin, end = texts.at[i], texts.at[i + 1]
                        edge = np.diff(np.concatenate([[False], covered[begin:end], [False]]).astype(np.int8))
                        ranges = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
                        rows.append({"kind": 0, "key": int(keys[i]), "text": text, "ranges": ranges.astype(np.int64).tobytes()})
                    yield batch_of(rows)
                    raw = texts.data.tobytes()
                    for g, (least, most) in enumerate(GROUPS):
                        has = (sides >> np.uint64(g) & np.uint64(1)) > 0
                        wide = (sides >> np.uint64(len(GROUPS) + g) & np.uint64(1))[has] > 0
                        part = _dealt(a.anchor[loose[has]], a.sides[loose[has]], g, n_parts)
                        for j, to, each in zip(loose[has].tolist(), part.tolist(), wide.tolist()):
                            p, i = int(a.p[j]), int(a.owner[j])
                            lo, hi, side, begin = max(int(a.lo[j]), p - most), min(int(a.hi[j]), p - least), p - least, int(texts.at[i])
                            one, key = int(ids[i]), int(keys[i])
                            if each:
                                for w in range(lo, hi + 1):
                                    window = raw[w : w + WIDTH]
                                    open_.append((zlib.crc32(window) % n_parts, window, b"", one, key, w - begin))
                            else:
                                open_.append((to, raw[side : hi + WIDTH], raw[lo:side], one, key, lo - begin))
                            if len(open_) >= HELD_OPEN:
                                yield runs(open_)
                                open_ = []
        if open_:
            yield runs(open_)

    return documents.mapInArrow(run, _CUT)


def _decode(row: dict) -> tuple[list[int], list[bytes], list[bytes], list[int], list[int], list[int]]:
    shared, ends = list(row["shared"]), np.cumsum([0, *row["length"]]).tolist()
    rest = [row["rest"][a:b] for a, b in zip(ends[:-1], ends[1:])]
    ends = np.cumsum([0, *row["at"]]).tolist()
    before = [row["before"][a:b] for a, b in zip(ends[:-1], ends[1:])]
    return shared, rest, before, *(np.frombuffer(row[c], np.int64).tolist() for c in ("ids", "keys", "lo"))


def _merge_open(cut: DataFrame) -> DataFrame:
    """Merges the runs of each part; key and ranges of the windows that a smaller id holds too."""

    def compare(group: list[tuple[bytes, int, int, int]], out: dict[int, list[int]]) -> None:
        if len({e[1] for e in group}) < 2:
            return
        least: dict[bytes, int] = {}
        for span, one, _, _ in group:
            for j in range(len(span) - WIDTH + 1):
                window = span[j : j + WIDTH]
                if least.get(window, one) >= one:
                    least[window] = one
        for span, one, key, lo in group:
            for j in range(len(span) - WIDTH + 1):
                if least[span[j : j + WIDTH]] < one:
                    out.setdefault(key, []).extend((lo + j, lo + j + WIDTH))

    def merge(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = [_decode(row) for batch in batches for row in batch.to_pylist()]
        out: dict[int, list[int]] = {}
        group: list[tuple[bytes, int, int, int]] = []
        for i, j, suffix, known in merge_runs([(r[0], r[1]) for r in found]):
            if known < SIDE and group:
                compare(group, out)
                group = []
            _, _, before, ids, keys, lo = found[i]
            group.append((before[j] + suffix, ids[j], keys[j], lo[j]))
        compare(group, out)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(out), pa.int64()), pa.array([np.array(v, np.int64).tobytes() for v in out.values()], pa.binary())], ["key", "more"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _one_part_at_a_time(batches):
            yield merge(part)

    runs = cut.where("kind = 1").select("part", "shared", "rest", "length", "before", "at", "ids", "keys", "lo")
    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "key long, more binary").groupBy("key").agg(F.collect_list("more").alias("more"))


def _remove(texts: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 from texts, their settled ranges and those found in the merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            for text, ranges, more in zip(*(batch.column(c).to_pylist() for c in ("text", "ranges", "more"))):
                raw = text.encode("utf-8")
                both = np.frombuffer(ranges + b"".join(more or []), np.int64).reshape(-1, 2)
                depth = np.bincount(both[:, 0], minlength=len(raw) + 1) - np.bincount(both[:, 1], minlength=len(raw) + 1)
                covered = np.cumsum(depth)[: len(raw)] > 0
                removed.append(int(covered.sum()))
                spans.append(int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum()))
                digests.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~covered].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                ["key", "n_removed", "n_spans", "kept_sha256"],
            )

    return texts.mapInArrow(run, "key long, n_removed long, n_spans long, kept_sha256 string")


def _order_id() -> Column:
    """doc_id for comparisons; a null one is the smallest."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def dedup(documents: DataFrame, crowded: int = CROWDED, sample: int = SAMPLE, wide: int = WIDE) -> DataFrame:
    """Removes each byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per input row. Strings never cross documents
    and are judged on the input. A null text counts as empty and loses nothing, as do texts below 50 bytes. A null
    doc_id is smaller than all others; rows that share a doc_id take nothing from each other. Repeated rows get the
    same answer each. An empty table gives no rows. Other columns are ignored.

    Whole copies need no sorting: all bytes of a copy of a smaller document's text go, if there are 50. ``crowded``,
    ``sample`` and ``wide`` say how spans are dealt to tasks; no result depends on them.
    """
    docs = documents.select("doc_id", _order_id().alias("id"), row_key().alias("key"), text_or_empty().alias("text"))
    rows = materialize(
        docs.select("doc_id", "id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "suffix-rows"
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    n_parts = int(1 + total // PART_BYTES)
    least = rows.groupBy("sha").agg(F.min("id").alias("least"))
    rows = materialize(rows.join(least, "sha").withColumn("copy", F.col("id") > F.col("least")).drop("least"), "suffix-classes")
    own = rows.where("NOT copy AND n_bytes >= 50").select("id").distinct()
    hot = _crowded(docs, sample, crowded)
    answers = materialize(_answer_spans(_send_spans(docs, n_parts, hot), wide).join(own, "id", "left_semi"), "suffix-answers")
    told = keep_keys(docs.select("id", "key", "text"), answers.select("id"), "id").join(answers.hint("shuffle_hash"), "id")
    cut = store_packed(_cut_spans(told, n_parts), "suffix-runs")
    texts = cut.where("kind = 0").select("key", "text", "ranges").join(_merge_open(cut), "key", "left")
    changed = _remove(texts).dropDuplicates(["key"])
    whole = F.col("copy") & (F.col("n_bytes") >= WIDTH)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    own_answer = F.coalesce("kept_sha256", F.lower(F.hex("sha")))
    return rows.join(changed, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).when(F.col("copy"), 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).when(F.col("copy"), 0).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).when(F.col("copy"), F.lower(F.hex("sha"))).otherwise(own_answer).alias("kept_sha256"),
    )
