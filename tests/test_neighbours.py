import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import neighbours, recommend
from cadenza.operators.grid import fit_grid
from cadenza.operators.neighbours import nearest
from cadenza.operators.scaling import fit_scaler

FEATURES = ["f0", "f1", "f2"]


def catalogue(spark, values, names):
    rows = [(i, name, f"['{name}']", *map(float, v)) for i, (name, v) in enumerate(zip(names, values))]
    return spark.createDataFrame(rows, "id long, name string, artists string, f0 double, f1 double, f2 double")


def brute(values, names, n, metric, skip_title, skip_self):
    x = np.asarray(values, dtype=float)
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std == 0, 1, std)
    if metric == "euclidean":
        score = -np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    else:
        size = np.linalg.norm(z, axis=1)
        size = np.where(size == 0, 1, size)
        score = (z @ z.T) / size[:, None] / size[None]
    names = np.array([n_.lower() for n_ in names])
    out = {}
    for i in range(len(x)):
        allowed = np.ones(len(x), bool)
        if skip_title:
            allowed &= names != names[i]
        if skip_self:
            allowed[i] = False
        order = np.lexsort((np.arange(len(x)), -np.round(score[i], 9)))
        out[i] = [int(j) for j in order if allowed[j]][:n]
    return out


def answers(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.request_id, r["rank"])):
        out.setdefault(r.request_id, []).append(r.track_id)
    return out


def requests_for(tracks):
    return tracks.select(
        F.col("id").alias("request_id"), F.col("name").alias("title"), F.col("id").alias("track_id"), *FEATURES
    )


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("skip_title, skip_self", [(False, False), (True, False), (False, True)])
def test_same_as_brute_force_with_hot_copies_and_titles(spark, metric, skip_title, skip_self):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=(180, 3)), 3)
    values[:60] = values[0]  # a third of the catalogue is one vector
    values[170:] = values[170]
    names = [f"song {i % 40}" for i in range(180)]
    names[:70] = ["Same"] * 70  # and one title
    tracks = catalogue(spark, values, names)
    hits = nearest(
        requests_for(tracks), tracks, FEATURES, 5, metric, skip_title, skip_self,
        rows_per_cell=8, rows_per_block=16,
    )
    assert answers(hits) == brute(values, names, 5, metric, skip_title, skip_self)


@pytest.mark.parametrize("skip_title, skip_self", [(True, False), (True, True), (False, True)])
def test_one_vector_under_many_titles(spark, skip_title, skip_self):
    values = [(1, 2, 3)] * 60 + [(5, 1, 0), (0, 0, 1), (2, 2, 2)]
    names = ["Same"] * 12 + [f"t{i // 2}" for i in range(51)]
    tracks = catalogue(spark, values, names)
    hits = nearest(requests_for(tracks), tracks, FEATURES, 3, "cosine", skip_title, skip_self)
    assert answers(hits) == brute(values, names, 3, "cosine", skip_title, skip_self)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_unrelated_vectors_reach_many_cells(spark, metric):
    values = np.random.default_rng(8).normal(size=(400, 3))
    names = [f"s{i % 50}" for i in range(400)]
    tracks = catalogue(spark, values, names)
    hits = nearest(requests_for(tracks), tracks, FEATURES, 60, metric, True, rows_per_cell=3)
    assert answers(hits) == brute(values, names, 60, metric, True, False)


def test_a_track_without_a_value_is_no_answer(spark):
    values = np.random.default_rng(9).normal(size=(60, 3))
    tracks = catalogue(spark, values, [f"s{i}" for i in range(60)])
    gaps = tracks.withColumn("f1", F.when(F.col("id") % 7 != 3, F.col("f1")))
    hits = nearest(requests_for(tracks.where("id < 5 AND id <> 3")), gaps, FEATURES, 6, rows_per_cell=3)
    found = answers(hits)
    assert len(found) == 4 and all(len(ids) == 6 and all(i % 7 != 3 for i in ids) for ids in found.values())


def test_cells_of_one_pack_travel_as_one_row(spark):
    points = spark.createDataFrame([(float(i), float(-i)) for i in range(200)], "x double, y double")
    grid = fit_grid(points, ["x", "y"], rows_per_cell=1, max_cells=256)
    cells = points.withColumn("cell", grid.cell())
    grid.measure(cells)
    within = neighbours._cells_within(grid)(F.col("radius"), F.array("cell"), F.col("x"), F.col("y"))
    far, near = cells.withColumn("radius", F.lit(1e9)), cells.withColumn("radius", F.lit(1e-9))
    rows = {r.cell: r.left for r in far.withColumn("left", within).collect()}
    occupied = np.sort(grid.ids)
    full = -(-len(occupied) // neighbours.PACK)
    for cell, left in rows.items():
        assert len(left.packs) + len(left.cells) <= full + neighbours._MANY
        masked = [p * neighbours.PACK + b for p, m in zip(left.packs, left.masks) for b in range(64) if m >> b & 1]
        assert sorted([*left.cells, *occupied[masked].tolist()]) == [c for c in occupied.tolist() if c != cell]
    assert all(not r.left.packs and not r.left.cells for r in near.withColumn("left", within).collect())
    places = {r.cell: r.place for r in cells.select("cell", grid.place(F.col("cell")).alias("place")).collect()}
    assert all(occupied[place] == cell for cell, place in places.items())


def test_constant_feature_and_small_catalogue(spark):
    values = [(1, 5, 0), (2, 5, 1), (3, 5, 4)]
    names = ["a", "b", "B"]
    tracks = catalogue(spark, values, names)
    hits = nearest(requests_for(tracks), tracks, FEATURES, 10, "euclidean")
    assert answers(hits) == brute(values, names, 10, "euclidean", False, False)
    scaler = fit_scaler(tracks, FEATURES)
    assert [r.f1 for r in scaler.transform(tracks).collect()] == [0.0, 0.0, 0.0]
    assert scaler.stds[0] == pytest.approx(np.std([1, 2, 3]))


def test_enough_results_although_most_tracks_share_the_title(spark):
    values = [(i * 0.01, 1, 1) for i in range(30)] + [(9, 2, 3), (8, 1, 0), (7, 3, 3)]
    names = ["Same"] * 30 + ["x", "y", "z"]
    tracks = catalogue(spark, values, names)
    hits = nearest(requests_for(tracks), tracks, FEATURES, 3, "cosine", exclude_same_title=True)
    assert sorted(answers(hits)[0]) == [30, 31, 32]


def test_recommendation_lines_and_distinct_songs(spark):
    tracks = catalogue(spark, [(0, 0, 1), (1, 0, 0), (0, 1, 0)], ["a", "b", "c"])
    asked = requests_for(tracks)
    near = recommend.knn_recommendations(asked, tracks, FEATURES, 2)
    first = {r.request_id: r for r in near.where("rank = 1").collect()}
    assert first[0].track_id == 0 and first[0].line == "\ta by a"
    assert recommend.distinct_songs(near).count() == 3
    alike = recommend.cosine_recommendations(asked, tracks, FEATURES, 1)
    assert all(r.line.endswith(f"by {r.name}") for r in alike.collect())


def test_request_given_in_any_form(spark):
    song = {"f0": 1, "f1": 2.0, "f2": 3, "other": 9}
    table = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "f0 double, f1 double, f2 double")
    for given in (song, table.first(), [1, 2, 3], table.limit(1)):
        row = recommend.request_from(spark, given, FEATURES).first()
        assert (row.f0, row.f1, row.f2) == (1.0, 2.0, 3.0)
    with pytest.raises(ValueError, match="expected 3 feature values, got 2"):
        recommend.request_from(spark, [1, 2], FEATURES)
    with pytest.raises(TypeError):
        recommend.request_from(spark, "song", FEATURES)
    with pytest.raises(ValueError):
        nearest(table, table, FEATURES, 1, "manhattan")


def test_no_cross_join_in_the_plan(spark):
    tracks = catalogue(spark, np.random.default_rng(0).normal(size=(50, 3)), [f"s{i}" for i in range(50)])
    plan = nearest(requests_for(tracks), tracks, FEATURES, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
