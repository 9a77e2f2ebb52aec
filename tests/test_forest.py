"""Forests: splits by Spark and inside a task must be the same, and both those of a plain recursive search."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import forest, listener

FEATURES = ["danceability", "energy", "tempo"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = [
        (run, i + 1, float(rng.integers(0, 6)), float(rng.integers(0, 4)), float(rng.random()), int(rng.integers(0, 4)))
        for run in (1, 2)
        for i in range(90)
    ]
    return spark.createDataFrame(data, "run int, row_no long, danceability double, energy double, tempo double, label long")


def plain_tree(x, y, w, node=1, depth=0, deepest=60):
    n, total = w.sum(), (w * y).sum()
    here = {node: (None, None, total / n, n)}
    if y.min() == y.max() or depth == deepest:
        return here
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            l, r = w[left].sum(), w[~left].sum()
            sl, sr = (w * y)[left].sum(), (w * y)[~left].sum()
            score = sl * sl / l + sr * sr / r
            if best is None or score > best[0]:
                best = score, f, (a + b) / 2, left
    if best is None:
        return here
    _, f, threshold, left = best
    here[node] = (f, threshold, total / n, n)
    here |= plain_tree(x[left], y[left], w[left], 2 * node, depth + 1, deepest)
    return here | plain_tree(x[~left], y[~left], w[~left], 2 * node + 1, depth + 1, deepest)


@pytest.mark.parametrize(("rows_per_task", "deepest"), [(20_000, 60), (12, 60), (1, 4)])
def test_trees_equal_a_plain_search(spark, rows, rows_per_task, deepest):
    grown = forest.grow(rows, FEATURES, 3, 42, deepest, rows_per_task).collect()
    got = {}
    for r in grown:
        got.setdefault((r.run, r.tree), {})[r.node] = (r.feature, r.threshold, r.value, r.n)
    data = np.array(rows.select("run", "row_no", *FEATURES, "label").collect(), float)
    for run in (1, 2):
        mine = data[data[:, 0] == run]
        for tree in (1, 2, 3):
            weight = np.zeros(len(mine))
            for i in range(1, len(mine) + 1):
                text = f"42|{run}|{tree}|{i}"
                weight[int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % len(mine)] += 1
            order = np.argsort(mine[:, 1])
            mine, used = mine[order], weight > 0
            expected = plain_tree(mine[used, 2:5], mine[used, 5], weight[used], deepest=deepest)
            assert got[run, tree] == expected


def test_both_ways_of_predicting_agree(spark, rows, monkeypatch):
    fitted = forest.Forest(forest.grow(rows, FEATURES, 30, 1), FEATURES, 30).of_run(2)
    asked = rows.where("run = 2").withColumn("tempo", F.when(F.col("row_no") > 3, F.col("tempo")))
    sent = {r.row_no: r.predicted_count for r in fitted.predict(asked).collect()}
    monkeypatch.setattr(forest, "SENT_NODES", 1)
    monkeypatch.setattr(forest, "ROWS_PER_TASK", 20)
    met = {r.row_no: r.predicted_count for r in fitted.predict(asked).collect()}
    assert len(sent) == 87 and met == pytest.approx(sent)


def test_one_song_predicts_its_count(spark):
    song = spark.createDataFrame([("a", "t", 7, 0.1, 0.2, 0.3)], "artist string, track string, count long, danceability double, energy double, tempo double")
    fitted = listener.constant_forest(song, FEATURES)
    assert {r.predicted_count for r in fitted.predict(song.unionByName(song)).collect()} == {7.0}
