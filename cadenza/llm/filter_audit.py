"""What each of five filters removes, in every order of applying them, by wide packed counters.

The filters a document fails form a mask of five bits. For each mask there is one big integer with a field for each of
the 600 (order, step) pairs, 1 where a document of that mask is removed there. The sum of these integers over a part's
documents holds all 600 counts at once. Every field is as wide as the number of documents has bits, so that no field
can run into the next. All reported columns are read from the fields of three such sums: all, good and toxic documents.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_or_empty
from cadenza.session import materialize

# The filters' letters, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80
MOST_CAPITALS = 10
ODD_CHARACTERS = "[#$%&*|]"

ORDERS = ["".join(order) for order in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda word: word != "")
    bare = F.translate(text, _CAPITALS, "")

    def bits(split: Column) -> Column:
        n = F.size(split).cast("long")
        few = n < LEAST_WORDS
        dull = 100 * F.size(F.array_distinct(split)).cast("long") < LEAST_DISTINCT * n
        return F.when(few, 1).otherwise(0) + F.when(dull, 2).otherwise(0)

    # The words are bound once: a one-element array through transform.
    by_words = F.get(F.transform(F.array(words), bits), F.lit(0))
    length = F.length(text).cast("long")
    loud = 100 * (length - F.length(bare)) > MOST_CAPITALS * length
    odd = F.regexp_like(text, F.lit(ODD_CHARACTERS))
    return (by_words + F.when(loud, 4).otherwise(0) + F.when(odd, 8).otherwise(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: part, mask (bits 0 to 4: A to E), good, toxic.

    E fails where a smaller doc_id has the same text. The first id of each text comes from partial minima; rows find out
    whether they are it by a join on doc_id, never on the text, so a text held by a third of all rows stays spread.
    """
    rows = materialize(
        docs.select(
            "doc_id",
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("sha"),
            text_mask(text_or_empty()).alias("mask"),
        ),
        "audit-rows",
    )
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    named = rows.where("doc_id IS NOT NULL")
    first = named.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    first = first.groupBy("doc_id").agg(F.collect_set("sha").alias("first_of"))
    again = ~F.coalesce(F.array_contains("first_of", F.col("sha")), F.lit(False))
    known = named.join(first, "doc_id", "left").join(marks, "doc_id", "left").select(
        "part",
        (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    )
    nameless = rows.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.unionByName(nameless)


def removed_at(mask: int, order: str, step: int) -> bool:
    """Whether a document of this mask gets through the steps before and fails the filter of this one."""
    fails = [mask >> FILTERS.index(letter) & 1 for letter in order[:step]]
    return bool(fails[-1]) and not any(fails[:-1])


def packed(width: int) -> list[int]:
    """For each of the 32 masks, the integer whose field ``i`` (``width`` bits) is 1 if step ``i`` removes the document."""
    return [
        sum(1 << (i * width) for i, (order, step) in enumerate(STEPS) if removed_at(mask, order, step))
        for mask in range(1 << len(FILTERS))
    ]


def unpacked(total: int, width: int) -> dict[tuple[str, int], int]:
    field = (1 << width) - 1
    return {at: total >> (i * width) & field for i, at in enumerate(STEPS)}


def report(part: str, documents: int, sums: tuple[int, int, int], width: int) -> pd.DataFrame:
    """The 600 rows of a part from its three sums (all, good and toxic documents)."""
    gone, good, toxic = (unpacked(total, width) for total in sums)
    # Whatever fails a filter is removed by it when it comes first, and what fails nothing else when it comes last.
    fails = {letter: next(gone[o, 1] for o in ORDERS if o[0] == letter) for letter in FILTERS}
    alone = {letter: next(gone[o, len(FILTERS)] for o in ORDERS if o[-1] == letter) for letter in FILTERS}
    shapley = dict.fromkeys(FILTERS, 0)
    for order, step in STEPS:
        shapley[order[step - 1]] += gone[order, step]
    rows = []
    for order in ORDERS:
        kept = documents
        for step, letter in enumerate(order, 1):
            at = order, step
            kept -= gone[at]
            rows.append((part, order, step, kept, gone[at], fails[letter] - gone[at], alone[letter], good[at], toxic[at], shapley[letter]))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return pd.DataFrame(rows, columns=names)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows per part (value of ``lang``; null: empty string): filter_order, step and the counts.

    Equal documents are counted before they are packed (at most 128 rows a part reach the task that adds its integers), so
    neither a hot part nor a hot text meets in one task. Null texts count as empty; a null doc_id is neither smaller than
    any id nor has a smaller one, and has no labels; rows that repeat an id and text are all first or all not; an id
    labelled more than once is good or toxic if one label says so. Empty ``docs`` gives no rows. Other columns do not
    matter, whatever their names.
    """
    counts = masks(docs, labels).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    counts = materialize(counts, "audit-masks")
    documents = counts.agg(F.sum("n")).first()[0] or 0
    width = max(1, int(documents).bit_length())

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        one = packed(width)
        sums = [0, 0, 0]
        for mask, good, toxic, n in zip(rows["mask"], rows["good"], rows["toxic"], rows["n"], strict=True):
            here = one[int(mask)] * int(n)
            sums[0] += here
            sums[1] += here * bool(good)
            sums[2] += here * bool(toxic)
        return report(rows["part"].iloc[0], int(rows["n"].sum()), tuple(sums), width)

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counts.groupBy("part").applyInPandas(total, schema)
