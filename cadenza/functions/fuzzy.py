"""Fuzzy text ratio and cheap upper bounds for it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Alphabet that survives text cleaning, and a split of it into classes. Any split gives valid bounds.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
CLASSES = ["ae", "iou", "rst", "dhlmn", "bcfgjkpqvwxyz", "0123456789 "]

_REPEATS = 3  # occurrences of one character that the bit signature tells apart
_PER_WORD = 20  # characters per 64-bit signature word
_BUDGET = 4_000_000  # mask cells held at a time


def _char_matrix(texts: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Texts as rows of small character codes, padded with 0."""
    out = np.zeros((len(texts), max(1, int(lengths.max(initial=0)))), dtype=np.int32)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = np.searchsorted(table, points) + 1
    return out


def common_lengths(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Longest-common-subsequence length and summed text length of each pair.

    Bit-parallel over whole texts of any length.

    Texts that repeat within the batch are prepared once.
    """
    a_of, a_texts = pd.factorize(left)
    b_of, b_texts = pd.factorize(right)
    a_texts, b_texts = np.asarray(a_texts, dtype=object), np.asarray(b_texts, dtype=object)
    points = "".join([*a_texts, *b_texts]).encode("utf-32-le")
    table = np.unique(np.frombuffer(points, dtype=np.uint32))
    n_b = np.array([len(s) for s in b_texts], dtype=np.int64)
    b_codes = _char_matrix(b_texts, n_b, table)
    n_a = np.array([len(s) for s in a_texts], dtype=np.int64)
    result = np.zeros(len(left), dtype=np.int64)
    by_length = np.argsort(n_a, kind="stable")
    start = 0
    while start < len(by_length):
        # As many left texts of like length as fit the mask budget.
        stop = start + 1
        while stop < len(by_length):
            words = -(-int(n_a[by_length[stop]]) // 64)
            if (stop - start + 1) * (len(table) + 1) * max(1, words) > _BUDGET:
                break
            stop += 1
        chosen = by_length[start:stop]
        place = np.full(len(a_texts), -1, dtype=np.int64)
        place[chosen] = np.arange(len(chosen))
        rows = np.flatnonzero(place[a_of] >= 0)
        result[rows] = _common(
            _char_matrix(a_texts[chosen], n_a[chosen], table),
            n_a[chosen],
            place[a_of[rows]],
            b_codes[b_of[rows]],
            len(table) + 1,
        )
        start = stop
    return result, n_a[a_of] + n_b[b_of]


def _common(
    a_codes: np.ndarray, n_a: np.ndarray, a_of: np.ndarray, b: np.ndarray, symbols: int
) -> np.ndarray:
    words = max(1, -(-int(n_a.max(initial=0)) // 64))
    every_a = np.arange(len(a_codes))
    masks = np.zeros((words, len(a_codes), symbols), dtype=np.uint64)
    for i in range(a_codes.shape[1]):
        masks[i // 64, every_a, a_codes[:, i]] |= np.uint64(1 << (i % 64))
    masks[:, :, 0] = 0  # padding matches nothing
    flat = masks.reshape(words, -1)
    base = a_of * symbols
    state = np.full((words, len(a_of)), ~np.uint64(0))
    for j in range(b.shape[1]):
        at = base + b[:, j]
        carry = None
        for w in range(words):
            hit = flat[w].take(at)
            old = state[w]
            both = old & hit
            full = old + both
            over = full < old
            if carry is not None:
                bumped = full + carry
                over |= bumped < full
                full = bumped
            state[w] = full | (old ^ both)
            carry = over.astype(np.uint64) if words > 1 else None
    used = np.zeros(len(a_of), dtype=np.int64)
    for w in range(words):
        inside = np.clip(n_a[a_of] - 64 * w, 0, 64).astype(np.uint64)
        valid = np.where(
            inside == 64, ~np.uint64(0), (np.uint64(1) << (inside % np.uint64(64))) - np.uint64(1)
        )
        used += np.bitwise_count(~state[w] & valid).astype(np.int64)
    return used


def common_matrix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Longest-common-subsequence length of every left text with every right text, of any length.

    A beginning that neighbouring left texts share is walked once for all of them, so sorted texts cost
    little more than the characters in which they differ.
    """
    points = "".join([*left, *right]).encode("utf-32-le")
    table = np.unique(np.frombuffer(points, dtype=np.uint32))
    n_a = np.array([len(s) for s in left], dtype=np.int64)
    n_b = np.array([len(s) for s in right], dtype=np.int64)
    a, b = _char_matrix(left, n_a, table), _char_matrix(right, n_b, table)
    words = max(1, -(-int(n_b.max(initial=0)) // 64))
    masks = np.zeros((words, len(table) + 1, len(right)), dtype=np.uint64)
    for i in range(b.shape[1]):
        masks[i // 64, b[:, i], np.arange(len(right))] |= np.uint64(1 << (i % 64))
    masks[:, 0] = 0  # padding matches nothing
    begins = np.ones(a.shape, dtype=bool)  # where a text leaves the one before it
    begins[1:] = np.logical_or.accumulate(a[1:] != a[:-1], axis=1)
    result = np.zeros((len(left), len(right)), dtype=np.int64)
    state = [np.full((1, len(right)), ~np.uint64(0)) for _ in range(words)]
    node = np.zeros(len(left), dtype=np.int64)
    for j in range(int(n_a.max(initial=0))):
        new = begins[:, j] & (n_a > j)
        starts = np.flatnonzero(new)
        came, letters = node[starts], a[starts, j]
        carry = None
        for w in range(words):
            old = state[w][came]
            both = old & masks[w][letters]
            full = old + both
            if words > 1:
                over = full < old
                if carry is not None:
                    bumped = full + carry
                    over |= bumped < full
                    full = bumped
                carry = over.astype(np.uint64)
            both ^= old
            full |= both
            state[w] = full
        node = np.cumsum(new) - 1
        ended = np.flatnonzero(n_a == j + 1)
        for w in range(words):
            result[ended] += np.bitwise_count(~state[w][node[ended]])
    return result


def as_ratio(common: np.ndarray, size: np.ndarray) -> np.ndarray:
    """0-100 similarity ``2 * common / (len + len)``, halves rounded to even; blank texts score 0."""
    share = np.divide(2.0 * common, size, out=np.zeros(size.shape), where=size > 0)
    return np.rint(100 * share).astype(np.int32)


def ratio_of(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Similarity of each pair of texts."""
    return as_ratio(*common_lengths(left, right))


@F.pandas_udf(T.IntegerType())
def fuzzy_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two cleaned texts; a missing text counts as blank."""
    return pd.Series(ratio_of(left.fillna(""), right.fillna("")))


SIGNATURE_WORDS = -(-len(ALPHABET) // _PER_WORD)

_SIGNATURE = T.StructType(
    [T.StructField("length", T.DoubleType())]
    + [T.StructField(f"class{i}", T.DoubleType()) for i in range(len(CLASSES))]
    + [T.StructField(f"bits{w}", T.LongType()) for w in range(SIGNATURE_WORDS)]
    + [T.StructField("rest", T.IntegerType())]
)


def signature_of(texts: pd.Series) -> pd.DataFrame:
    """Length, class counts, and bits telling how often each character occurs (up to 3 times)."""
    table = np.array(sorted(ord(c) for c in ALPHABET), dtype=np.uint32)
    places = {c: int(np.searchsorted(table, ord(c))) for c in ALPHABET}
    lengths = texts.str.len().to_numpy(dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    counts = np.zeros((len(texts), len(ALPHABET)), dtype=np.int64)
    np.add.at(counts, (np.repeat(np.arange(len(texts)), lengths), np.searchsorted(table, points)), 1)
    out: dict[str, np.ndarray] = {"length": lengths.astype(float)}
    for i, chars in enumerate(CLASSES):
        out[f"class{i}"] = counts[:, [places[c] for c in chars]].sum(axis=1).astype(float)
    seen = np.minimum(counts, _REPEATS)
    for w in range(SIGNATURE_WORDS):
        part = seen[:, w * _PER_WORD : (w + 1) * _PER_WORD]
        shifts = _REPEATS * np.arange(part.shape[1])
        out[f"bits{w}"] = (((1 << part) - 1) << shifts).sum(axis=1)
    out["rest"] = (counts - seen).sum(axis=1).astype(np.int32)
    return pd.DataFrame(out)


@F.pandas_udf(_SIGNATURE)
def text_signature(texts: pd.Series) -> pd.DataFrame:
    return signature_of(texts)


def shared_at_most(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Most characters that each text signed in ``a`` can have in common with each one signed in ``b``."""
    shared = np.minimum(a["rest"].to_numpy()[:, None], b["rest"].to_numpy()[None])
    for w in range(SIGNATURE_WORDS):
        bits = a[f"bits{w}"].to_numpy()[:, None] & b[f"bits{w}"].to_numpy()[None]
        shared = shared + np.bitwise_count(bits)
    return shared
