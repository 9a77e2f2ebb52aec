"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel of two strings sums, over all four-letter subsequences they share, the product of their weights; a
subsequence spread over ``span`` characters weighs DECAY ** (span - 4), up to SPAN characters. Gaps are
free to hold anything, so letters pulled apart or with characters put between them still count. Landmarks are
words of the training sentences; kernel values against them, whitened, are the Nyström features of a linear
machine trained on sentences, each represented by its worst stretch. The machine's weights, carried back through
the landmarks, are one weight per subsequence: scoring a text is exact evaluation of the machine over every
stretch of the whole text by table lookups, and a document's score is that of its worst stretch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Texts, pieces, remainder, text_or_empty

LENGTH, SPAN, DECAY = 4, 7, 0.6
#: Letters a-z are 1-26, letters of other scripts fall into 27-37 by their last byte, all else is 0.
SYMBOLS = 38
#: Start positions of one stretch.
STRETCH = 12
#: Fitted on about so many documents of each label, and on so many words as landmarks.
SAMPLE_DOCS, LANDMARKS, COMMON = 900, 240, 60
#: Sentences of a clean document that training looks at, at most, spread evenly.
SENTENCES = 40
#: Zeros between texts: neither a subsequence nor a stretch reaches over them.
PAD = max(SPAN, STRETCH)
OFFSETS = [c for c in combinations(range(1, SPAN), LENGTH - 1)]


def symbol_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 0x1F) % 11
    return table


def stream(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each followed by PAD zeros, and the place where each text begins (and the end)."""
    keep = texts.data < 0xC0  # the first byte of a longer character says nothing about case or letter
    kept = np.concatenate([[0], np.cumsum(keep)])[texts.at]
    at = kept + PAD * np.arange(texts.n + 1)
    out = np.zeros(at[-1], np.uint8)
    symbols = symbol_table()[texts.data[keep]]
    out[np.arange(len(symbols)) + PAD * np.repeat(np.arange(texts.n), np.diff(kept))] = symbols
    return out, at


def codes(symbols: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For each choice of gaps its weight and the code of the subsequence from each position on."""
    n = max(0, len(symbols) - SPAN)
    wide = symbols.astype(np.int32)
    first = wide[:n] * SYMBOLS**3
    second = {i: first + wide[i : i + n] * SYMBOLS**2 for i in range(1, SPAN - 2)}
    for i, j, k in OFFSETS:
        yield DECAY ** (k + 1 - LENGTH), second[i] + wide[j : j + n] * SYMBOLS + wide[k : k + n]


def stretches(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over STRETCH positions from each on; 0 from the zeros that follow a text."""
    total = np.concatenate([[0.0], np.cumsum(points, dtype=np.float64)])
    sums = total[np.minimum(np.arange(len(points)) + STRETCH, len(points))] - total[:-1]
    sums[(at[1:, None] - np.arange(1, PAD + 1)).ravel()] = 0.0
    return sums


def word_symbols(word: str) -> np.ndarray:
    data = word.encode()
    return stream(Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[0]


@dataclass
class Machine:
    """Weights by subsequence code, and the logistic curve from the worst stretch to the score."""

    support: np.ndarray
    weights: np.ndarray
    slope: float
    middle: float

    def table(self) -> np.ndarray:
        table = np.zeros(SYMBOLS**LENGTH, np.float32)
        table[self.support] = self.weights
        return table

    def worst(self, texts: Texts, table: np.ndarray) -> np.ndarray:
        """The largest sum of one stretch in each text; 0 for an empty one."""
        symbols, at = stream(texts)
        points = _points(symbols, table)
        best = np.zeros(texts.n)
        full = np.flatnonzero(np.diff(at) > PAD)
        if len(full):
            sums = stretches(points, at)
            best[full] = np.maximum.reduceat(sums, at[full])
        return best

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (worst - self.middle), -40, 40)))


def _points(symbols: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The machine's sum over the subsequences that start at each position."""
    points = np.zeros(len(symbols), np.float32)
    for weight, code in codes(symbols):
        points[: len(code)] += table[code] * np.float32(weight)
    return points


def _landmarks(sentences: list[str], toxic: np.ndarray, docs: np.ndarray) -> list[str]:
    """Words that lean most to toxic documents, and the most frequent other ones."""
    seen: dict[str, set] = {}
    for text, doc in zip(sentences, docs):
        for word in set(regex.findall(r"\p{L}{4,}", text.lower())):
            seen.setdefault(word, set()).add(doc)
    toxic_docs = set(docs[toxic].tolist())
    all_docs = max(len(set(docs.tolist())), 1)
    share = len(toxic_docs) / all_docs
    lean = {}
    for word, where in seen.items():
        hits = len(where & toxic_docs)
        lean[word] = (hits - share * len(where)) / np.sqrt(len(where) * share * (1 - share) + 1)
    worst = sorted(lean, key=lambda w: (-lean[w], w))[:LANDMARKS]
    usual = sorted(seen, key=lambda w: (-len(seen[w]), w))
    return list(dict.fromkeys([w for w in worst if lean[w] > 1.5] + [w for w in usual if lean[w] <= 1.5][:COMMON]))


def _maps(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' normalised subsequence weights (landmark, support) and the support's codes."""
    each = []
    for word in words:
        found: Counter = Counter()
        for weight, code in codes(word_symbols(word)):
            for c in code.tolist():
                # Every letter of a subsequence must be one.
                if c % SYMBOLS and c // SYMBOLS % SYMBOLS and c // SYMBOLS**2 % SYMBOLS and c // SYMBOLS**3:
                    found[c] += weight
        norm = np.sqrt(sum(v * v for v in found.values())) or 1.0
        each.append({c: v / norm for c, v in found.items()})
    support = np.array(sorted(set().union(*each)), np.int64)
    place = {c: i for i, c in enumerate(support.tolist())}
    maps = np.zeros((len(words), len(support)), np.float32)
    for i, found in enumerate(each):
        for c, v in found.items():
            maps[i, place[c]] = v
    return maps, support


def _kernel_rows(symbols: np.ndarray, starts: np.ndarray, maps: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """Kernel values of the stretches at ``starts`` against all landmarks."""
    cells = np.minimum(starts[:, None] + np.arange(STRETCH + SPAN), len(symbols) - 1)
    block = symbols[cells].astype(np.int32)
    out = np.zeros((len(starts), len(maps)), np.float32)
    columns = np.ascontiguousarray(maps.T)
    for i, j, k in OFFSETS:
        code = ((block[:, :STRETCH] * SYMBOLS + block[:, i : i + STRETCH]) * SYMBOLS + block[:, j : j + STRETCH]) * SYMBOLS
        code += block[:, k : k + STRETCH]
        at = lookup[code]
        who, where = np.nonzero(at >= 0)
        if len(who):
            weight = np.float32(DECAY ** (k + 1 - LENGTH))
            first = np.flatnonzero(np.diff(who, prepend=-1))
            for a in range(0, len(first), 4096):  # bounded pieces
                stop = first[a + 4096] if a + 4096 < len(first) else len(who)
                part = slice(first[a], stop)
                out[who[first[a : a + 4096]]] += weight * np.add.reduceat(columns[at[who[part], where[part]]], first[a : a + 4096] - first[a])
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Squared-hinge machine in the primal, by Newton steps on the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1), z.dtype)]).astype(np.float64)
    u = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        active = y * (x @ u) < 1
        xa = x[active] * weight[active, None]
        fresh = np.linalg.solve(ridge + 2 * c * xa.T @ x[active], 2 * c * xa.T @ y[active])
        if np.allclose(fresh, u, atol=1e-7):
            break
        u = fresh
    return u[:-1], float(u[-1])


def train(text: list[str], toxic: np.ndarray, rounds: int = 4) -> Machine | None:
    """Fits landmarks, machine and curve. Two thirds of the documents fit the machine, the rest the curve.

    In every round a toxic document stands with its three worst sentences, a clean one with all, each sentence
    with its worst stretch under the weights so far.
    """
    if len(set(toxic.tolist())) < 2:
        return None
    part = np.arange(len(text)) % 3 < 2
    sentences, owner = [], []
    for i in np.flatnonzero(part):
        own = [s for s in regex.split(r"(?<=[.!?])\s+|\n+", text[i]) if s.strip()]
        if not toxic[i]:
            own = own[:: max(1, -(-len(own) // SENTENCES))]
        sentences += own
        owner += [i] * len(own)
    owner = np.array(owner)
    if not sentences or len(set(toxic[owner].tolist())) < 2:
        return None
    words = _landmarks(sentences, toxic[owner] == 1, owner)
    if not words:
        return None
    maps, support = _maps(words)
    gram = (maps @ maps.T).astype(np.float64)
    value, vector = np.linalg.eigh(gram)
    good = value > 1e-4 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    lookup = np.full(SYMBOLS**LENGTH, -1, np.int32)
    lookup[support] = np.arange(len(support))
    symbols, at = stream(Texts.of(pa.array(sentences, pa.large_string())))
    y = np.where(toxic[owner] == 1, 1.0, -1.0)
    # To begin with, a subsequence weighs by how much more often toxic sentences have it.
    hits = np.zeros((2, len(support)))
    side = np.repeat((y > 0).astype(int), np.diff(at))
    for weight, code in codes(symbols):
        where = lookup[code]
        found = np.flatnonzero(where >= 0)
        for s in (0, 1):
            hits[s] += weight * np.bincount(where[found[side[found] == s]], minlength=len(support))
    rate = (hits + 0.5) / (hits.sum(axis=1, keepdims=True) + 0.5 * len(support))
    weights = np.log(rate[1] / rate[0])
    for _ in range(rounds):
        table = np.zeros(SYMBOLS**LENGTH, np.float32)
        table[support] = weights
        sums = stretches(_points(symbols, table), at)
        long = np.diff(at) > PAD
        best, start = np.full(len(sentences), -np.inf), at[:-1].copy()
        begin = at[:-1][long]
        best[long] = np.maximum.reduceat(sums, begin)
        peak = np.flatnonzero(sums == np.repeat(best, np.diff(at)))
        first = np.searchsorted(peak, at[:-1][long])
        start[long] = peak[np.minimum(first, len(peak) - 1)]
        rank = pd.Series(-best).groupby(owner).rank(method="first").to_numpy()
        use = np.isfinite(best) & ((y < 0) | (rank <= 3))
        kernel = _kernel_rows(symbols, start[use], maps, lookup)
        yu = y[use]
        balance = np.where(yu > 0, (yu < 0).sum() / max((yu > 0).sum(), 1), 1.0)
        u, _ = _svm(kernel @ whiten, yu, np.minimum(balance, 20.0))
        weights = (whiten @ u) @ maps
    machine = Machine(support, weights.astype(np.float32), 1.0, 0.0)
    rest = np.flatnonzero(~part)
    rest = rest if len(set(toxic[rest].tolist())) == 2 else np.arange(len(text))
    worst = machine.worst(Texts.of(pa.array([text[i] for i in rest], pa.large_string())), machine.table())
    machine.slope, machine.middle = _curve(worst, toxic[rest])
    return machine


def _curve(worst: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the two labels' values; the clean label has 0.7 of the weight."""
    x = np.stack([worst, np.ones(len(worst))], axis=1)
    w = np.where(toxic == 1, 0.3 / max((toxic == 1).sum(), 1), 0.7 / max((toxic == 0).sum(), 1))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        b -= np.linalg.solve(hessian, x.T @ (w * (p - toxic)) + 1e-4 * b)
    slope = max(b[0], 1e-6)
    return float(slope), float(-b[1] / slope)


def fit(documents: DataFrame, labels: DataFrame, docs_per_label: int = SAMPLE_DOCS) -> Machine | None:
    """Trains on a sample: of each label about ``docs_per_label`` documents, those whose id hash is below a bar.

    Only rows with an id, a label and a remainder other than 0 are drawn.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = marked.groupBy("toxic").agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.lit(1 << 30))
    chosen = marked.join(F.broadcast(counts), "toxic").where(draw <= (1 << 30) * (F.lit(float(docs_per_label)) / F.col("_n")))
    # About 2 * docs_per_label rows by the bar above, so small enough to send to every executor.
    rows = documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    got = rows.toPandas().sort_values(["doc_id", "text"]).reset_index(drop=True)
    got = got[got.groupby("toxic").cumcount() < 2 * docs_per_label]
    return train(got["text"].tolist(), got["toxic"].to_numpy().astype(int)) if len(got) else None


def score(documents: DataFrame, machine: Machine | None) -> DataFrame:
    """Returns doc_id, score, predicted, worst for every whole text.

    A null or empty text is scored as one without any weight. Without a machine every score is 0. Repeated rows and
    null ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = machine.table() if machine else None
        for batch, texts in pieces(batches):
            worst = machine.worst(texts, table) if machine else np.zeros(texts.n)
            points = machine.score(worst) if machine else np.zeros(texts.n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(points), pa.array((points >= 0.5).astype(np.int32)), pa.array(worst)],
                ["doc_id", "score", "predicted", "worst"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, worst double")


def detect(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on labelled rows whose id hash modulo 5 is not 0 and scores all: doc_id, held_out, score, predicted, worst.

    Null and empty texts are scored as texts without any weight. Repeated rows and null ids are kept; a null id is never
    held out nor fitted on. An id labelled both 0 and 1 counts as toxic. Without labelled rows every
    score is 0; an empty ``documents`` gives no rows. Other columns are ignored.
    """
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(documents, fit(documents, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted", "worst")
