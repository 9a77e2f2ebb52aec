import math

import numpy as np
import pytest

from cadenza.operators import clusters, listener

FEATURES = ["danceability", "energy"]


def history(spark, n=20):
    rng = np.random.default_rng(1)
    rows = [(f"a{i}", f"s{i}", int(5 + i), float(x), float(y)) for i, (x, y) in enumerate(rng.random((n, 2)))]
    return spark.createDataFrame(rows, "artist string, track string, count long, danceability double, energy double")


def songs(spark, n=60):
    rng = np.random.default_rng(2)
    rows = [(i, f"a{i}", f"s{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.random((n, 2)))]
    return spark.createDataFrame(rows, "id long, artist string, track string, danceability double, energy double")


def test_history_keeps_songs_without_features_until_cleaned(spark):
    plays = spark.createDataFrame([("A", "x")] * 3 + [("B", "y")] * 2 + [("C", "z")], "artist string, track string")
    hits = spark.createDataFrame(
        [("A", "x", "1"), ("B", "y", "2"), ("C", "z", None)], "artist string, track string, spotify_id string"
    )
    records = spark.createDataFrame(
        [("https://h/track/1", 0.5, 0.2), ("https://h/track/9", 0.1, 0.1)], "href string, danceability double, energy double"
    )
    rows = listener.listener_history(plays, hits, records, FEATURES, 2)
    assert sorted((r.artist, r["count"], r.danceability) for r in rows.collect()) == [("A", 3, 0.5), ("B", 2, None)]
    heard = listener.usable_history(rows, FEATURES)
    catalogue = spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "id long, artist string, track string")
    assert [r.id for r in listener.candidates(catalogue, heard).collect()] == [2]
    assert listener.candidates(catalogue, rows).count() == 0


def test_taste_profile_is_weighted_by_plays(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (3, 1.0, 1.0)], "count long, danceability double, energy double")
    assert tuple(listener.taste_profile(rows, FEATURES).first()) == (0.75, 1.0)


def test_training_rows_balance_and_do_not_overlap(spark):
    heard = history(spark)
    unheard = listener.candidates(songs(spark), heard)
    rows = listener.training_rows(heard, unheard, FEATURES, 3).collect()
    positives = {(r.artist, r.track) for r in rows if r["count"] > 0}
    negatives = {(r.artist, r.track) for r in rows if r["count"] == 0}
    assert len(positives) == len(negatives) == 20 and not positives & negatives


def test_forest_predicts_evaluates_and_recommends(spark):
    heard = history(spark)
    unheard = listener.candidates(songs(spark), heard)
    runs, forest = listener.evaluate_forest(heard, unheard, FEATURES, repeats=2, trees=5)
    summary = listener.error_summary(runs).first()
    assert summary.rmse == pytest.approx(math.sqrt(summary.mse)) and summary.mse > 0
    best = listener.forest_recommendations(forest, unheard, 7).collect()
    counts = [r.predicted_count for r in best]
    assert len(best) == 7 and counts == sorted(counts, reverse=True)
    assert 0 <= counts[-1] <= 24
    alone, _ = listener.evaluate_forest(heard, None, FEATURES, repeats=1, trees=5)
    assert alone.first().mse > 0
    with pytest.raises(ValueError, match="two training rows"):
        listener.fit_forest(heard.limit(1), FEATURES, 5)


def test_clusters_elbow_and_projection(spark):
    rng = np.random.default_rng(4)
    centres = [(0, 0), (9, 9), (0, 9)]
    rows = [(i, *(np.array(centres[i % 3]) + rng.normal(0, 0.1, 2)).tolist()) for i in range(60)]
    tracks = spark.createDataFrame(rows, "id long, danceability double, energy double")
    labels = {r.id: r.cluster for r in clusters.cluster_tracks(tracks, FEATURES, 3, restarts=6).collect()}
    assert len(set(labels.values())) == 3 and all(labels[i] == labels[i % 3] for i in range(60))
    elbow = {r.k: r.inertia for r in clusters.elbow_table(tracks, FEATURES, 3, restarts=4).collect()}
    assert elbow[1] == pytest.approx(120.0) and elbow[3] < elbow[2] < elbow[1]
    flat = clusters.project_2d(tracks, FEATURES).collect()
    assert np.var([r.pc1 for r in flat]) >= np.var([r.pc2 for r in flat])
