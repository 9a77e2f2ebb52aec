"""Language identification with a convolutional network over bytes.

Filters of several widths run over fixed-length windows, each keeps its largest response in the window, and a
softmax names the language. Over one-hot bytes a filter is a sum of table rows, one per offset, so the forward pass
is gathers and additions; neighbouring offsets are folded into tables over byte pairs when texts are scored.
The weights are trained on all windows of all texts that have a language: tasks train copies of them in numpy, whose mean
Spark takes round by round. Every text is then scored whole, window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Texts, mix, pieces, remainder, row_key, text_or_empty

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: About so many windows start the weights, in one task; each later round has GROWTH times the windows of all before.
FIRST_WINDOWS, GROWTH = 16_384, 16
#: Windows that a task of a later round trains on, about; slices in which weights are added up.
PART_WINDOWS, SLICES = 65_536, 16
#: Draws are below this.
DRAWS = 1 << 63
#: Adam's steps: passes over the windows of the first round, windows a step, least number of steps, rates of the first and later rounds.
EPOCHS, BATCH, LEAST_STEPS, RATE, LATER_RATE = 4, 128, 300, 0.02, 0.004
#: Least probability at which a text counts as recognised.
LEAST = 0.4
#: Windows scored at once.
BLOCK = 512


@dataclass
class Network:
    langs: list[str]
    tables: dict[int, np.ndarray]  # width -> offset, byte, filter
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def windows(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: bytes (window, position), owning text, length. The rest of a last window is 0."""
    length = np.diff(texts.at)
    each = -(-length // WINDOW)
    owner = np.repeat(np.arange(texts.n), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = texts.at[owner] + nth * WINDOW
    size = np.minimum(WINDOW, length[owner] - nth * WINDOW)
    cells = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    return np.where(inside, texts.data[np.minimum(cells, max(len(texts.data) - 1, 0))], 0).astype(np.uint8), owner, size


def _respond(net: Network, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Largest response of each filter in each window, and where it is."""
    single = np.ascontiguousarray(x.T)  # positions first: the maximum runs over whole rows
    best, where = [], {}
    for width, table in net.tables.items():
        n = WINDOW - width + 1
        act = table[0].take(single[:n], axis=0)
        for k in range(1, width):
            act += table[k].take(single[k : k + n], axis=0)
        where[width] = act.argmax(axis=0)
        best.append(np.take_along_axis(act, where[width][None], axis=0)[0])
    return np.concatenate(best, axis=1), where


def start(langs: list[str], seed: int = 7) -> Network:
    """Random weights, the same for the same seed."""
    rng = np.random.default_rng(seed)
    f = FILTERS * len(WIDTHS)
    return Network(
        langs,
        {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(f, np.float32),
        rng.normal(0, 0.1, (f, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )


def parameters(net: Network) -> list[np.ndarray]:
    return [*net.tables.values(), net.bias, net.dense, net.dense_bias]


class Trainer:
    """Adam on the cross-entropy, on a copy of the weights; only the bytes under each filter's best place get a gradient."""

    def __init__(self, net: Network, weight: np.ndarray, rate: float):
        self.net = Network(net.langs, {w: t.copy() for w, t in net.tables.items()}, net.bias.copy(), net.dense.copy(), net.dense_bias.copy())
        self.weight, self.rate, self.step = weight, rate, 0
        self.params = parameters(self.net)
        self.first, self.second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]

    def learn(self, xb: np.ndarray, yb: np.ndarray) -> None:
        """One step on a batch of windows and the places of their languages."""
        net = self.net
        pooled, where = _respond(net, xb)
        hidden = np.maximum(pooled + net.bias, 0)
        logits = hidden @ net.dense + net.dense_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(yb)), yb] -= 1
        p *= (self.weight[yb] / len(yb))[:, None]
        p = p.astype(np.float32)
        back = (p @ net.dense.T) * (hidden > 0)
        grads = []
        for i, (width, table) in enumerate(net.tables.items()):
            g = np.zeros_like(table)
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(width):
                byte = np.take_along_axis(xb, where[width] + k, axis=1)
                np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), part)
            grads.append(g)
        grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
        self.step += 1
        for q, g, m, v in zip(self.params, grads, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


class Scorer:
    """The network with its tables folded over byte pairs."""

    def __init__(self, net: Network):
        self.net, self.parts = net, {}
        for width, table in net.tables.items():
            pairs = [
                np.ascontiguousarray((table[k][:, None] + table[k + 1][None, :]).reshape(65536, FILTERS))
                for k in range(0, width - 1, 2)
            ]
            self.parts[width] = pairs, table[width - 1] if width % 2 else None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.net.langs)))
        for at in range(0, len(x), BLOCK):
            single = np.ascontiguousarray(x[at : at + BLOCK].T)  # positions first: the maximum runs over whole rows
            pair = single[:-1].astype(np.int32) << 8 | single[1:]
            best = []
            for width, (pairs, odd) in self.parts.items():
                n = WINDOW - width + 1
                act = pairs[0].take(pair[:n], axis=0)
                for k, table in enumerate(pairs[1:], 1):
                    act += table.take(pair[2 * k : 2 * k + n], axis=0)
                if odd is not None:
                    act += odd.take(single[width - 1 : width - 1 + n], axis=0)
                best.append(act.max(axis=0))
            hidden = np.maximum(np.concatenate(best, axis=1) + self.net.bias, 0)
            logits = (hidden @ self.net.dense + self.net.dense_bias).astype(np.float64)
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[at : at + BLOCK] = p / p.sum(axis=1, keepdims=True)
        return out

    def texts(self, texts: Texts) -> np.ndarray:
        """Mean probabilities of each text's windows, by their lengths; zeros for an empty text."""
        total = np.zeros((texts.n, len(self.net.langs)))
        x, owner, size = windows(texts)
        p = self.probabilities(x) * size[:, None]
        for j in range(total.shape[1]):
            total[:, j] = np.bincount(owner, p[:, j], texts.n)
        return total / np.maximum(np.diff(texts.at), 1)[:, None]


def _cut(langs: list[str], low: int, high: int) -> Callable:
    """Windows whose draw is from ``low`` up to ``high``: draw, place of the language, bytes."""
    place = {v: i for i, v in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            x, owner, _ = windows(texts)
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            key = batch.column("key").to_numpy().view(np.uint64)[owner]
            draw = mix(key + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
            keep = (draw >= np.uint64(low)) & (draw < np.uint64(high))
            lang = np.array([place[v] for v in batch.column("lang").to_pylist()], np.int32)[owner[keep]]
            at = np.arange(int(keep.sum()) + 1, dtype=np.int32) * WINDOW
            held = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x[keep]))])
            yield pa.RecordBatch.from_arrays([pa.array(draw[keep].view(np.int64)), pa.array(lang), held], ["draw", "lang", "w"])

    return run


def _learn(net: Network, weight: np.ndarray, first: bool) -> Callable:
    """Trains a copy of the network on the windows of a task; its weights in SLICES slices, times the number of windows.

    The windows of the ``first`` round are few and seen several times, all others once.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            w = batch.column("w")
            at = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + 1]
            x = np.frombuffer(w.buffers()[2], np.uint8)[at[0] : at[0] + len(w) * WINDOW].reshape(-1, WINDOW) if len(w) else np.zeros((0, WINDOW), np.uint8)
            yield x, batch.column("lang").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = Trainer(net, weight, RATE if first else LATER_RATE), 0
        if first:
            parts = [(x.copy(), y) for x, y in read(batches)]
            x, y = np.concatenate([x for x, _ in parts] or [np.zeros((0, WINDOW), np.uint8)]), np.concatenate([y for _, y in parts] or [np.zeros(0, np.int32)])
            seen, rng = len(y), np.random.default_rng(7)
            for _ in range(max(EPOCHS, -(-LEAST_STEPS // max(1, -(-seen // BATCH))))) if seen else ():
                order = rng.permutation(seen)
                for at in range(0, seen, BATCH):
                    trainer.learn(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
        else:
            for x, y in read(batches):
                for at in range(0, len(y), BATCH):
                    trainer.learn(x[at : at + BATCH], y[at : at + BATCH])
                seen += len(y)
        if seen:
            flat = np.concatenate([p.ravel() for p in trainer.params]).astype(np.float64) * seen
            parts = [v.tobytes() for v in np.array_split(flat, SLICES)]
            no, n = pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()), pa.array([seen] * SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), no, n, pa.array(parts, pa.binary())], ["slice", "no", "n", "part"])

    return run


def _mean(net: Network, told: DataFrame) -> Network:
    """The mean of the tasks' weights, by their windows; added up in Spark, a slice in one task and in the tasks' order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for i, n, part in zip(batch.column("slice").to_pylist(), batch.column("n").to_pylist(), batch.column("part")):
                have = sums.setdefault(i, [0, 0])
                have[0] += n
                have[1] = have[1] + np.frombuffer(part.as_buffer(), np.float64)
        columns = [pa.array(list(sums), pa.int32()), pa.array([(v[1] / v[0]).astype(np.float32).tobytes() for v in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "part"])

    got = told.repartition("slice").sortWithinPartitions("slice", "no").mapInArrow(add, "slice int, part binary").toPandas().sort_values("slice")
    if got.empty:
        return net
    flat, params, at = np.concatenate([np.frombuffer(b, np.float32) for b in got["part"]]), [], 0
    for p in parameters(net):
        params.append(flat[at : at + p.size].reshape(p.shape).copy())
        at += p.size
    return Network(net.langs, dict(zip(net.tables, params)), *params[-3:])


def fit(documents: DataFrame, first_windows: int = FIRST_WINDOWS, part_windows: int = PART_WINDOWS) -> Network | None:
    """Trains on every window of every document with a language and letters. Returns None when there is none.

    Each window draws a number from its document's id and text and its place. The about ``first_windows`` lowest are one task's,
    which starts the weights. Every later round takes the next windows, GROWTH times all before, and each once: tasks of
    about ``part_windows``, in the order of the draws, train copies of the weights that the round before left, and the copies'
    mean goes on. Languages weigh the same, however many windows they have. Where the rows lie in files has no influence.
    """
    rows = documents.select(row_key().alias("key"), "text", "lang").where(F.col("lang").isNotNull() & text_or_empty().rlike(r"\p{L}"))
    each = F.ceil(F.octet_length("text") / F.lit(WINDOW))
    counts = {r["lang"]: int(r["n"]) for r in rows.groupBy("lang").agg(F.sum(each).alias("n")).collect()}
    if not counts:
        return None
    langs, total = sorted(counts), sum(counts.values())
    weight = np.array([total / (len(langs) * counts[v]) for v in langs])
    net, low, share = start(langs), 0, min(1.0, first_windows / total)
    while low < DRAWS:
        high = DRAWS if share >= 1 else int(share * DRAWS)
        tasks = 1 if not low else max(1, round(total * (high - low) / DRAWS / part_windows))
        drawn = rows.mapInArrow(_cut(langs, low, high), "draw long, lang int, w binary").repartition(tasks, "draw").sortWithinPartitions("draw")
        net = _mean(net, drawn.mapInArrow(_learn(net, weight, not low), "slice int, no int, n long, part binary"))
        low, share = high, share * GROWTH
    return net


def predict(documents: DataFrame, net: Network | None) -> DataFrame:
    """Returns doc_id, lang_pred, score for every text, scored whole.

    ``und`` with score 0 for a null text, one without letters, or when there is no network. Ties go to the language
    first by code point. Repeated rows and null ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch, texts in pieces(batches):
            lettered = batch.column("_lettered").to_numpy(zero_copy_only=False)
            if scorer:
                p = scorer.texts(texts)
                best, score = p.argmax(axis=1), np.where(lettered, np.minimum(p.max(axis=1), 1.0), 0.0)
                langs = [net.langs[b] if ok else "und" for b, ok in zip(best, lettered)]
            else:
                langs, score = ["und"] * len(batch), np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), text_or_empty().rlike(r"\p{L}").alias("_lettered")
    )
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Fits on the rows whose id hash modulo 4 is not 2, and predicts all: doc_id, held_out, lang_pred, score.

    ``held_out`` is false for a null id, which is also never fitted on.
    """
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    net = fit(documents.where(F.col("doc_id").isNotNull() & ~held_out))
    return predict(documents, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_recognised(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents, with all their columns, whose language is recognised.

    Rejected are texts without letters, and those whose best language has a probability below ``least``. The network is
    fitted as in identify. Where no row has a language to learn from, only texts without letters are rejected.
    """
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    net = fit(documents.where(F.col("doc_id").isNotNull() & ~held_out))

    @F.arrow_udf("boolean")
    def recognised(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(net) if net else None
        for column in columns:
            found = [scorer.texts(texts).max(axis=1) >= least for _, texts in pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]))] if scorer else []
            yield pa.array(np.concatenate(found) if found else np.ones(len(column), bool))

    return documents.where(text_or_empty().rlike(r"\p{L}")).where(recognised(F.col("text")))
