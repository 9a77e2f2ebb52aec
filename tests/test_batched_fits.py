"""Batched k-means, projection, fractional samples and pairing by position."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import clusters, sampling
from cadenza.plans import reports

FEATURES = ["danceability", "energy"]


@pytest.fixture(scope="module")
def tracks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.normal(size=2) * (3, 1) + (i % 3 * 4, 0))) for i in range(150)]
    rows += [(200, None, 1.0), (201, rows[0][1], rows[0][2])]
    return spark.createDataFrame(rows, "id long, danceability double, energy double").repartition(3)


def lloyd(x, centres):
    centres = centres.copy()
    for _ in range(300):
        away = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        label = away.argmin(axis=1)
        moved = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(len(centres))])
        if np.abs(moved - centres).max() < 1e-10:
            break
        centres = moved
    return away.min(axis=1).sum(), label


def test_all_models_together_equal_one_at_a_time(spark, tracks):
    points = clusters._points(tracks, FEATURES)
    models = clusters.starting_points(points, 2, [1, 2, 4, 7], 3, 64)
    fitted = clusters.fit_models(points, 2, models)
    x = np.array(points.orderBy("id").select("z0", "z1").collect())
    assert len(x) == 151 and len(fitted) == 12
    for model, (inertia, _) in fitted.items():
        assert inertia == pytest.approx(lloyd(x, models[model])[0])
    labelled = {r.id: r.cluster for r in clusters.cluster_tracks(tracks, FEATURES, 4, 3).collect()}
    best = min(range(3), key=lambda r: (round(fitted[4, r][0], 6), r))
    ids = [r.id for r in points.orderBy("id").collect()]
    assert labelled.pop(200) is None
    assert labelled == dict(zip(ids, lloyd(x, models[4, best])[1].tolist()))


def test_projection_equals_the_decomposition(spark, tracks):
    flat = {r.id: (r.pc1, r.pc2) for r in clusters.project_2d(tracks, FEATURES).collect()}
    rows = [r for r in tracks.collect() if r.danceability is not None]
    x = np.array([(r.danceability, r.energy) for r in rows])
    x -= x.mean(axis=0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    for r, point in zip(rows, x @ axes.T):
        assert flat[r.id] == pytest.approx(tuple(point))
    spread = np.diag([5.0, 5.0, 1.0])
    assert clusters.principal_axes(spread, 2) == pytest.approx(np.eye(3)[:2])
    assert clusters.project_2d(tracks.limit(0), FEATURES).count() == 0


def test_a_fraction_is_the_same_on_any_layout(spark):
    rows = spark.range(3000).select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("b"))
    first = sorted(map(str, sampling.sample_fraction(rows, 0.3, 5).collect()))
    again = sorted(map(str, sampling.sample_fraction(rows.repartition(7, "b"), 0.3, 5).collect()))
    assert first == again and 750 < len(first) < 1050
    assert first != sorted(map(str, sampling.sample_fraction(rows, 0.3, 6).collect()))
    copies = spark.range(20_000).select(F.lit("same").alias("a"))
    assert 9_500 < sampling.sample_fraction(copies, 0.5, 1).count() < 10_500
    assert sampling.sample_fraction(rows, 0.0, 1).count() == 0
    assert sampling.sample_fraction(rows, 1.0, 1).count() == 3000


def test_lists_are_zipped_to_the_shorter(spark):
    tracks = spark.createDataFrame([("u", 10 * i, f"t{i}") for i in range(5)] + [("v", 1, "x"), (None, 1, "n")], "who string, at int, track string")
    records = spark.createDataFrame([("u", 9 - i, f"r{i}") for i in range(3)] + [("w", 1, "y"), (None, 1, "n")], "who string, nth int, record string")
    got = {(r.who, r.place, r.track, r.record) for r in reports.paired_by_position(tracks, records, ["who"], ["at"], ["nth"]).collect()}
    assert got == {("u", 1, "t0", "r2"), ("u", 2, "t1", "r1"), ("u", 3, "t2", "r0")}


def test_points_lie_in_parts_for_several_tasks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(400)]
    catalogue = spark.createDataFrame(rows, "id long, danceability double, energy double").coalesce(1)
    points = clusters._points(catalogue, FEATURES)
    assert points.count() == 400
    assert len(points.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
