"""Exact token counts of every prefix under a byte-level BPE vocabulary, by dynamic programming.

Cut a text into the vocabulary's pretokens. Inside a pretoken, each prefix has exactly one last token: the token ``t``
ending there for which the last token of the prefix before it, ``s``, and ``t`` stay two tokens when ``s + t`` is encoded.
So ``count[i] = count[i - len(t)] + 1``, from left to right. The table answers the count of the text, of any
prefix, and the longest prefix within a budget, without encoding anything again.

Equal pretokens share one row of the table, all rows of a piece advance together, one byte a step, in numpy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Hasher, Texts, pieces

#: The code points that the vocabulary's pattern takes as white space.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the vocabulary's pattern splits off.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 9
#: Known pretokens that a task keeps; beyond it the store starts anew (results do not depend on it).
STORE = 400_000
#: Bytes from which a pretoken is worked on by itself.
LONG = 64


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        words = spec["model"]["vocab"]
        self.tokens = [b""] * (max(words.values()) + 1)
        for word, number in words.items():
            self.tokens[number] = bytes(letters[c] for c in word)
        self.rank = {}
        merges = []
        for i, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[words[left], words[right]] = (i, words[left + right])
            merges.append((words[left], words[right], words[left + right]))
        # Of each token the merge that makes it (-1: a single byte) and its two parts.
        self.made, self.left, self.right = (np.full(len(self.tokens), -1, np.int64) for _ in range(3))
        if merges:
            left, right, both = np.array(merges, np.int64).T
            self.made[both[::-1]], self.left[both[::-1]], self.right[both[::-1]] = np.arange(len(both))[::-1], left[::-1], right[::-1]
            codes = left << 32 | right
            self.merge_rank = np.argsort(codes, kind="stable")
            self.merge_codes = codes[self.merge_rank]
        else:
            self.merge_codes = self.merge_rank = np.zeros(0, np.int64)
        self.single = [0] * 256
        for number, token in enumerate(self.tokens):
            if len(token) == 1:
                self.single[token[0]] = number
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.longest = max(map(len, self.tokens))
        by_length: dict[int, list[int]] = {}
        for number, token in enumerate(self.tokens):
            if token:
                by_length.setdefault(len(token), []).append(number)
        self.hasher = Hasher()
        self.by_length = {}
        for length, numbers in by_length.items():
            data = np.frombuffer(b"".join(self.tokens[i] for i in numbers), np.uint8)
            starts = np.arange(len(numbers)) * length
            keys = self.hasher.stretches(self.hasher.sums(data), starts, starts + length)
            order = np.argsort(keys)
            self.by_length[length] = keys[order], np.array(numbers, np.int64)[order]
        self.numbers = {token: number for number, token in enumerate(self.tokens) if token}
        self._one: dict[tuple[int, int], bool] = {}
        self._pairs_known = np.zeros(0, np.int64)
        self._pairs_apart = np.zeros(0, bool)

    def encode(self, word: bytes) -> list[int]:
        """Merges of one short byte string, lowest rank first."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda i: self.rank.get((ids[i], ids[i + 1]), (1 << 60,))[0])
            merged = self.rank.get((ids[best], ids[best + 1]))
            if merged is None:
                break
            ids[best : best + 2] = [merged[1]]
        return ids

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undoes the merges inside two neighbouring tokens, latest first, and asks whether one across comes sooner.

        Of merges with one rank the left one is done first: it wins against a merge across, the right one loses.
        """
        apart = np.ones(len(left), bool)
        a, b, who = left.copy(), right.copy(), np.arange(len(left))
        until = np.full(len(left), len(self.merge_codes) * 2 + 2)  # twice the rank, one more where a tie crosses
        while len(who) and len(self.merge_codes):
            codes = a << 32 | b
            at = np.minimum(np.searchsorted(self.merge_codes, codes), len(self.merge_codes) - 1)
            crosses = (self.merge_codes[at] == codes) & (2 * self.merge_rank[at] < until)
            apart[who[crosses]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~crosses & ((made_a >= 0) | (made_b >= 0))
            a, b, who, made_a, made_b = a[go], b[go], who[go], made_a[go], made_b[go]
            undo_a = made_a > made_b
            until = np.where(undo_a, 2 * made_a, 2 * made_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return apart

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two tokens, written side by side, are encoded as just these two."""
        codes = left << 32 | right
        asked, back = np.unique(codes, return_inverse=True)
        if len(self._pairs_known):
            at = np.minimum(np.searchsorted(self._pairs_known, asked), len(self._pairs_known) - 1)
            known = self._pairs_known[at] == asked
        else:
            at, known = np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        answer = np.zeros(len(asked), bool)
        answer[known] = self._pairs_apart[at[known]]
        fresh = asked[~known]
        if len(fresh):
            verdict = self._apart(fresh >> 32, fresh & 0xFFFFFFFF)
            answer[~known] = verdict
            where = np.searchsorted(self._pairs_known, fresh)
            self._pairs_known = np.insert(self._pairs_known, where, fresh)
            self._pairs_apart = np.insert(self._pairs_apart, where, verdict)
        return answer[back]

    def long_counts(self, word: bytes) -> np.ndarray:
        """Counts of all prefixes of one long stretch, from 0 on."""
        sizes = sorted(self.by_length, reverse=True)
        number = self.numbers
        last, count = [-1] * (len(word) + 1), np.zeros(len(word) + 1, np.int64)
        for i in range(1, len(word) + 1):
            for size in sizes:
                if size > i:
                    continue
                token = number.get(word[i - size : i])
                if token is None:
                    continue
                before = last[i - size]
                if i == size:
                    good = self.encode(self.tokens[token]) == [token]
                else:
                    good = self._one_apart(before, token)
                if good:
                    last[i], count[i] = token, count[i - size] + 1
                    break
        return count

    def _one_apart(self, left: int, right: int) -> bool:
        if (left, right) not in self._one:
            self._one[left, right] = bool(self._apart(np.array([left]), np.array([right]))[0])
        return self._one[left, right]

    def prefix_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Counts of all prefixes of the stretches: per step i, the stretches of at least i bytes and their counts."""
        sums = self.hasher.sums(data)
        order = np.argsort(starts - ends, kind="stable")  # longest first
        starts, length = starts[order], (ends - starts)[order]
        n, deepest = len(starts), int(length.max(initial=0))
        keep = min(self.longest, deepest) + 1  # rows of the last steps, used in turn
        last = np.full((keep, n), -1, np.int64)
        count = np.zeros((keep, n), np.int64)
        steps = []
        for i in range(1, deepest + 1):
            live = int(np.searchsorted(-length, -i, "right"))
            begin = starts[:live]
            row = i % keep
            last[row, :live] = -1
            open_ = np.arange(live)
            for size in range(min(i, self.longest), 0, -1):
                if size not in self.by_length or not len(open_):
                    continue
                keys, numbers = self.by_length[size]
                at = begin[open_] + i
                asked = self.hasher.stretches(sums, at - size, at)
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == asked)
                if not len(hit):
                    continue
                who, token = open_[hit], numbers[place[hit]]
                before = last[(i - size) % keep, who]
                if i > size:
                    good = before >= 0
                    good[good] = self.stay_apart(before[good], token[good])
                else:
                    # A first token must be what its own bytes are encoded as.
                    good = self.stay_whole(token)
                who, token = who[good], token[good]
                last[row, who] = token
                count[row, who] = (count[(i - size) % keep, who] if i > size else 0) + 1
                open_ = open_[last[row, open_] < 0]
            steps.append((order[:live], count[row, :live].copy()))
        return steps

    def stay_whole(self, tokens: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_whole"):
            self._whole = np.full(len(self.tokens), -1, np.int8)
        for token in np.unique(tokens[self._whole[tokens] < 0]):
            self._whole[token] = self.encode(self.tokens[token]) == [int(token)]
        return self._whole[tokens] == 1


class Cutter:
    """Pretokens of a piece, found from the classes of its code points."""

    def __init__(self, specials: list[str]):
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[SPACES] = SPACE
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.special_bytes = [s.encode() for s in specials]

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        for point in np.unique(points[kinds == UNKNOWN]):
            c = chr(int(point))
            self.kind[point] = LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER
        return self.kind[points]

    def cut(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all pretokens, and the byte starts of special tokens."""
        raw = texts.data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(points)
        none = np.zeros(0, np.int64)
        if not n:
            return none, none, none
        at_byte = np.append(np.flatnonzero((texts.data & 0xC0) != 0x80), len(raw))
        kinds = self._kinds(points)
        edge = np.zeros(n + 1, bool)  # texts and special tokens begin or end here
        edge[np.searchsorted(at_byte, texts.at)] = True
        special = np.zeros(n, bool)
        special_starts = []
        if self.specials and any(s in raw for s in self.special_bytes):
            for i in range(texts.n):
                piece = raw[texts.at[i] : texts.at[i + 1]]
                for match in self.specials.finditer(piece.decode("utf-8")):
                    base = int(np.searchsorted(at_byte, texts.at[i]))
                    a, b = base + match.start(), base + match.end()
                    edge[[a, b]] = True
                    special[a:b] = True
                    special_starts.append(at_byte[a])
        start = edge[:n].copy()  # where a pretoken begins
        start[1:] |= kinds[1:] != kinds[:-1]
        space = kinds == SPACE
        follows = np.zeros(n, bool)  # the next character is of this segment and no space
        follows[:-1] = ~space[1:] & ~edge[1:n]
        last_space = space & follows
        # The last space before a word stands by itself, and a plain blank takes the word with it.
        start |= last_space
        joined = np.flatnonzero(last_space & (points == 0x20)) + 1
        start[joined] = False
        self._endings(points, kinds, start, edge, n)
        start[special] = False
        first = np.zeros(n, bool)
        first[np.flatnonzero(edge[:n])] = True
        start[first & special] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        ordinary = ~special[begin]
        # Text after a special token starts at an edge, so no pretoken runs across one.
        return at_byte[begin[ordinary]], at_byte[end[ordinary]], np.array(special_starts, np.int64)

    @staticmethod
    def _endings(points: np.ndarray, kinds: np.ndarray, start: np.ndarray, edge: np.ndarray, n: int) -> None:
        quotes = np.flatnonzero((points == 0x27) & start)
        for quote in quotes:
            if quote + 1 < n and not edge[quote + 1] and kinds[quote + 1] == LETTER:
                tail = "".join(map(chr, points[quote : quote + 3]))
                stop = np.flatnonzero(edge[quote + 1 : quote + 3])
                tail = tail[: 1 + stop[0]] if len(stop) else tail
                for ending in ENDINGS:
                    if tail.startswith(ending):
                        start[quote + 1 : quote + len(ending)] = False
                        after = quote + len(ending)
                        if after < n and not (kinds[after] == SPACE):
                            start[after] = True
                        break


class Counter:
    """Counts of pretokens, each computed once and kept by its hash."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cutter = Cutter(self.vocabulary.specials)
        self.hasher = Hasher()
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def pretokens(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and token counts of the pretokens; starts of special tokens."""
        starts, ends, special = self.cutter.cut(texts)
        if not len(starts):
            return starts, ends, np.zeros(0, np.int64), special
        keys = self.hasher.stretches(self.hasher.sums(texts.data), starts, ends)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        fresh = np.ones(len(distinct), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            fresh = self.keys[at] != distinct
            counts[~fresh] = self.values[at[~fresh]]
        new = first[fresh]
        if len(new):
            whole = ends[new] - starts[new]
            found = np.zeros(len(new), np.int64)
            short = np.flatnonzero(whole <= LONG)
            for i, (who, count) in enumerate(self.vocabulary.prefix_counts(texts.data, starts[new[short]], ends[new[short]]), 1):
                done = whole[short[who]] == i
                found[short[who[done]]] = count[done]
            for i in np.flatnonzero(whole > LONG):
                found[i] = self.vocabulary.long_counts(texts.data[starts[new[i]] : ends[new[i]]].tobytes())[-1]
            counts[fresh] = found
            if len(self.keys) > STORE:
                self.keys, self.values = distinct, counts
            else:
                place = np.searchsorted(self.keys, distinct[fresh])
                self.keys = np.insert(self.keys, place, distinct[fresh])
                self.values = np.insert(self.values, place, found)
        return starts, ends, counts[back], special

    def totals(self, texts: Texts) -> np.ndarray:
        starts, _, counts, special = self.pretokens(texts)
        total = np.bincount(texts.owner(starts), counts, texts.n).astype(np.int64)
        return total + np.bincount(texts.owner(special), minlength=texts.n)

    def prefix_table(self, text: str) -> np.ndarray:
        """Tokens of every prefix that ends with a whole character: entry i is for ``text[:i]``.

        The pretokens of a prefix are those of the text, save what the cut itself changes: blanks at its end
        and an ending cut short. These few are cut and counted anew by the same table.
        """
        data = text.encode("utf-8")
        texts = Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        starts, ends, counts, special = self.pretokens(texts)
        tails = []
        at_char = np.append(np.flatnonzero((texts.data & 0xC0) != 0x80), len(data))
        edges = np.sort(np.concatenate([starts, special]))
        for i, end in enumerate(at_char):
            # Two pretokens back is safe: a cut changes at most the last two.
            k = max(0, int(np.searchsorted(edges, end, "left")) - 3)
            tails.append(data[int(edges[k]) if len(edges) else 0 : end])
        lengths = np.cumsum([0, *map(len, tails)])
        tail_texts = Texts(np.frombuffer(b"".join(tails), np.uint8), np.array(lengths))
        before = np.append(0, np.cumsum(counts))
        sure = [at_char[i] - len(t) for i, t in enumerate(tails)]
        base = before[np.searchsorted(starts, sure, "left")] + np.searchsorted(np.sort(special), sure, "left")
        return base + self.totals(tail_texts)


def longest_prefix(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(table <= budget)[-1])


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Returns doc_id, n_bytes, n_tokens, over_limit, one row per input row, in no order.

    ``vocabulary`` is the path of a byte-level BPE file that every executor can read. A null or empty text has no
    tokens. A special token's string in a text is that one token, as the vocabulary's library has it by default.
    Texts of any length are worked on whole; repeated rows and null ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch, texts in pieces(batches):
            counter = counter or Counter(vocabulary)
            total = counter.totals(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(texts.at)), pa.array(total), pa.array(total > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Returns doc_id and counts: entry i is the exact number of tokens of the text's first i characters.

    A null text has the table of an empty one, a single 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(vocabulary)
            for start in range(len(batch)):
                row = batch.slice(start, 1)
                table = counter.prefix_table(row.column("text")[0].as_py() or "")
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), pa.array([table.tolist()], pa.list_(pa.int64()))], ["doc_id", "counts"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, counts array<long>")
