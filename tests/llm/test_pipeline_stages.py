"""Every stage of the pipeline on a whole small table, against a plain version of it on the stage's own input."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="tables not present")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(docs):
    """Ids that stay: the least of each component, and texts without words."""
    sets = {d.doc_id: shingle_set(d.text) for d in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i for i in sets if not sets[i] or find(i) == i}


def test_stages_equal_plain_versions(spark):
    import corpus_pipeline
    from cadenza.llm import balance, language_cnn
    from cadenza.llm.common import documents, table
    from cadenza.session import materialize

    docs = documents(spark, SMALL)
    given, kept = docs.collect(), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = materialize(stage(spark, docs, SMALL), f"test-{name}")
        kept[name] = docs.collect()

    lettered = {d.doc_id for d in given if any(c.isalpha() for c in d.text or "")}
    named = {r.doc_id for r in language_cnn.identify(inputs["language_id"]).where("lang_pred <> 'und'").collect()}
    assert {d.doc_id for d in kept["language_id"]} == lettered == named

    assert {d.doc_id for d in kept["near_duplicates"]} == near_duplicates(kept["language_id"])

    items = [words(b.text) for b in table(spark, SMALL, "benchmark").collect()]
    parts = {tuple(w[i : i + 4]) for w in items for i in range(len(w) - 3)}
    left = {d.doc_id for d in kept["decontamination"]}
    for d in kept["near_duplicates"]:
        own = words(d.text)
        whole = " ".join(own)
        if any(" ".join(w) in whole for w in items if len(w) >= 8):
            assert d.doc_id not in left
        if not any(tuple(own[i : i + 4]) in parts for i in range(len(own) - 3)):
            assert d.doc_id in left

    copies = {r.doc_id: r.copies for r in balance.mix(inputs["mixing"]).collect() if r.copies}
    assert Counter(d.doc_id for d in kept["mixing"]) == Counter(copies)
    texts = {d.doc_id: d.text for d in given}
    assert all(d.text == texts[d.doc_id] for d in kept["mixing"])

    assert Counter(d.doc_id for d in kept["sharding"]) == Counter(copies)
    sizes = Counter(d.shard for d in kept["sharding"])
    assert set(sizes) <= set(range(16)) and max(sizes.values()) - min(sizes[k] for k in range(16)) <= 1
    slots = {(d.shard, d.slot) for d in kept["sharding"]}
    assert slots == {(k, i) for k in range(16) for i in range(sizes[k])}

    again = Counter((d.doc_id, d.shard, d.slot) for d in corpus_pipeline.run(spark, SMALL).collect())
    assert again == Counter((d.doc_id, d.shard, d.slot) for d in kept["sharding"])
