"""Ranked lexical search by accumulator-limited term-at-a-time evaluation over a document-partitioned index.

One pass over the documents keeps, of each, its length and its counts of the words asked for. Each task then evaluates
the items over the blocks of its documents: an item's words come rarest first and open accumulators, until what the
words to come can add at most is below the item's k-th score so far; from there on only open accumulators are
updated, all of them, with every word left. All scores are integers, and those that leave a task are whole.

The k-th score so far is known before the main round: the first round lets only each item's rarest words open
accumulators, finishes those, and takes the k-th best, which the k-th best of all documents cannot be below.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.numbering import number_rows
from cadenza.session import materialize

# Hits per item, and the constants of the score.
TOP = 50
SCALE, TF_PART, LENGTH_PART = 1_000_000_000, 1000, 20
FLAT, SHARE = 50, 50

#: Items answered in one pass; the driver and each task hold the words of so many items. More items take more passes.
ITEMS_AT_ONCE = 4096
#: In the first round, the rarest words open accumulators until their postings number this often TOP.
FIRST_ROUND = 20
#: Numbers in a task's block of documents by words.
BLOCK = 1 << 22
_PIECE = 1 << 20

# Bytes of the characters outside the separators: digits, letters, and every byte of a character above 0x7F.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")


def term_counts(text: str | None) -> Counter:
    """How often each term occurs; long texts are cut at separators, so that only one piece is split at a time."""
    data = (text or "").encode().lower()  # bytes: only A-Z change
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            stop = _BREAK.search(data, end)
            end = stop.start() if stop else len(data)
        found.update(_TERM.findall(data, at, end))
        at = end
    return found


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (of the vocabulary) of each document with a term; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                found = term_counts(text.as_py())
                if found:
                    asked = [(vocabulary[term], tf) for term, tf in found.items() if term in vocabulary]
                    kept.append(i)
                    sizes.append(found.total())
                    terms.append([term for term, _ in asked])
                    counts.append([tf for _, tf in asked])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "counts"],
            )

    fields = [docs.schema["doc_id"], *T._parse_datatype_string("n long, terms array<int>, counts array<long>").fields]
    return materialize(docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields)), "lexical-index")


@dataclass
class Plan:
    """The items of one pass: their terms rarest first, and the numbers that scores need."""

    orders: list[np.ndarray]
    weights: np.ndarray
    documents: int
    length: int

    def impacts(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What each posting adds to a score; ``sizes`` is its document's n."""
        m = 100 - FLAT + (SHARE * sizes * self.documents) // self.length
        return self.weights[terms] * ((SCALE * counts) // (TF_PART * counts + LENGTH_PART * m))


def plan(items: list[Counter], vocabulary: dict[bytes, int], postings: DataFrame) -> tuple[Plan, list[int]]:
    """The plan, and how many of each item's rarest terms open accumulators in the first round."""
    totals = postings.agg(F.count("*").alias("d"), F.sum("n").alias("l")).first()
    n_docs, length = totals["d"], totals["l"] or 1
    df = np.zeros(len(vocabulary) + 1, np.int64)
    # One row per word of the items of this pass.
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[row["term"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    orders, first = [], []
    for found in items:
        own = np.array(sorted((vocabulary[t] for t in found), key=lambda t: (df[t], t)), np.int64)
        own = own[df[own] > 0] if len(own) else own
        orders.append(own)
        first.append(int(np.searchsorted(np.cumsum(df[own]), FIRST_ROUND * TOP)) + 1)
    return Plan(orders, weights, n_docs, length), first


def _evaluate(plan: Plan, ids: pa.Array, id_type: pa.DataType, k: int, opening: Callable[[int, np.ndarray, np.ndarray], int], floors: np.ndarray) -> Callable:
    """A function for mapInArrow over the index: (item, item_id, doc_id, score) of each block's best documents.

    ``opening`` says how many of an item's terms open accumulators, given its number, which of its terms occur in the
    block, and the most that each can add there; results below the item's floor stay behind.
    """

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        terms, counts = batch.column("terms"), batch.column("counts")
        at = np.asarray(terms.offsets, np.int64)
        flat, times = np.asarray(terms.flatten(), np.int64), np.asarray(counts.flatten(), np.int64)
        at = at - at[0]
        sizes = np.asarray(batch.column("n"), np.int64)
        first = 0
        while first < len(batch):
            last = min(len(batch), first + 4096)
            while True:
                words = np.unique(flat[at[first] : at[last]])
                if (last - first) * len(words) <= BLOCK or last == first + 1:
                    break
                last = first + max(1, (last - first) // 2)
            part = slice(at[first], at[last])
            rows = np.repeat(np.arange(last - first), np.diff(at[first : last + 1]))
            yield batch.column("doc_id").slice(first, last - first), words, rows, flat[part], plan.impacts(flat[part], times[part], sizes[first + rows])
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(plan.weights), -1, np.int64)
        for batch in batches:
            for doc_ids, words, rows, terms, gains in blocks(batch):
                place[words] = np.arange(len(words))
                table = np.zeros((len(words), len(doc_ids)), np.int64)
                table[place[terms], rows] = gains
                most = table.max(axis=1) if len(doc_ids) else np.zeros(len(words), np.int64)
                rank = np.asarray(doc_ids.fill_null(np.iinfo(np.int64).max)) if pa.types.is_integer(doc_ids.type) else np.arange(len(doc_ids))
                items, hits, scores = [], [], []
                for item, order in enumerate(plan.orders):
                    here = place[order]
                    present = np.flatnonzero(here >= 0)
                    if not len(present):
                        continue
                    lines = here[present]
                    open_to = opening(item, present, most[lines])
                    score = table[lines[:open_to]].sum(axis=0)
                    live = np.flatnonzero(score)
                    if not len(live):
                        continue
                    score = score[live]
                    for line in lines[open_to:]:  # survivors only
                        score += table[line, live]
                    good = score >= max(1, floors[item])
                    live, score = live[good], score[good]
                    if len(live) > k:
                        best = np.lexsort((rank[live], -score))[:k] if pa.types.is_integer(doc_ids.type) else np.flatnonzero(score >= np.sort(score)[-k])
                        live, score = live[best], score[best]
                    items.append(np.full(len(live), item))
                    hits.append(live)
                    scores.append(score)
                place[words] = -1
                if items:
                    numbers = np.concatenate(items)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers, pa.int32()), ids.take(pa.array(numbers)), doc_ids.take(pa.array(np.concatenate(hits))), pa.array(np.concatenate(scores), pa.int64())],
                        ["item", "item_id", "doc_id", "score"],
                    )

    return run


def _answer(items: list, id_field: T.StructField, docs: DataFrame, k: int) -> DataFrame:
    """The hits of the items of one pass, given as (item_id, text) rows."""
    counted = [term_counts(row["text"]) for row in items]
    vocabulary = {term: i for i, term in enumerate(sorted(set().union(*counted)))}
    postings = index(docs, vocabulary)
    made, first = plan(counted, vocabulary, postings)
    schema = T.StructType([T.StructField("item", T.IntegerType()), id_field, docs.schema["doc_id"], T.StructField("score", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    ids = pa.array([row[0] for row in items], to_arrow_type(id_field.dataType))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())

    def best(opening: Callable, floors: np.ndarray) -> DataFrame:
        found = postings.mapInArrow(_evaluate(made, ids, ids.type, k, opening, floors), schema)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    floors = np.zeros(len(items), np.int64)
    rarest = best(lambda item, present, most: int(np.searchsorted(present, first[item])), floors)
    for row in rarest.where(F.col("rank") == k).select("item", "score").collect():  # one row per item of this pass
        floors[row["item"]] = row["score"]

    def while_it_matters(item: int, present: np.ndarray, most: np.ndarray) -> int:
        to_come = np.cumsum(most[::-1])[::-1]
        return int(np.count_nonzero(to_come >= floors[item]))

    return best(while_it_matters, floors).select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank (from 1), doc_id, score (above 0).

    Every row of ``items`` is an item and every row of ``docs`` a document, so repeated item_ids are answered once each and
    repeated doc_ids rank side by side. Equal scores go by ascending doc_id, null ids last. Null and empty texts have no
    terms: such items get no rows, such documents are in no count. An item with fewer documents above 0 gets them all.
    Empty tables give no rows. Other columns, whatever their names, are not looked at. A word of any length is a word.
    """
    asked = items.select("item_id", "text")
    id_field = asked.schema["item_id"]
    n = asked.count()
    if n <= ITEMS_AT_ONCE:
        passes = [asked.collect()]  # counted: at most ITEMS_AT_ONCE rows
    else:
        numbered = materialize(number_rows(asked, ["item_id", "text"], "_no"), "lexical-items")
        passes = (
            numbered.where(F.col("_no").between(start, start + ITEMS_AT_ONCE - 1)).select("item_id", "text").collect()
            for start in range(1, n + 1, ITEMS_AT_ONCE)
        )
    answers = None
    for rows in passes:
        found = _answer(rows, id_field, docs.select("doc_id", "text"), k)
        if n > ITEMS_AT_ONCE:
            found = materialize(found, "lexical-hits")
        answers = found if answers is None else answers.unionByName(found)
    return answers
