import json

import pytest

from cadenza.operators import listener
from cadenza.plans import reports
from cadenza.schema import FEATURES_11, TRACKS
from cadenza.sources import files, payloads, star_tables


def test_csv_columns_by_name_and_type(spark, tmp_path):
    path = tmp_path / "tracks.csv"
    others = ",".join(FEATURES_11)
    path.write_text(
        f"album,id,name,artists,{others}\n"
        f'X,t1,"Say ""Hi""","[\'A\', \'B\']",' + ",".join(["0.5"] * 9) + ",7,1\n"
        f"Y,t2,Gap,['C']," + ",".join([""] * 9) + ",7.0,bad\n"
    )
    rows = {r.id: r for r in files.read_tracks(spark, str(path)).collect()}
    assert rows["t1"].name == 'Say "Hi"' and rows["t1"].key == 7 and rows["t1"].album == "X"
    assert rows["t2"].tempo is None and rows["t2"].key == 7 and rows["t2"].mode is None
    assert files.read_tracks(spark, str(path), keep_others=False).columns == TRACKS.names
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="track_id"):
        files.read_listens(spark, str(bad))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_scrobbles(spark, str(tmp_path / "absent.csv"))


def test_export_headers_vary(spark, tmp_path):
    path = tmp_path / "plays.csv"
    path.write_text(" Artist,TRACK ,when\nA,x,1\nA,x,2\nB,y,3\n,z,4\n")
    counts = listener.play_counts(files.read_scrobbles(spark, str(path)))
    assert sorted(tuple(r) for r in counts.collect()) == [("A", "x", 2), ("B", "y", 1)]


def test_round_trips(spark, tmp_path):
    meta = spark.createDataFrame([("t1", "n", "a", 1)], "track_id string, name string, artist string, x int")
    files.write_track_metadata(meta, f"{tmp_path}/meta")
    assert files.read_track_metadata(spark, f"{tmp_path}/meta").columns == ["track_id", "name", "artist"]
    matrix = spark.createDataFrame([("t1", "u", 2.0)], "track_id string, user_id string, playcount double")
    files.write_interactions(matrix, f"{tmp_path}/matrix")
    assert files.read_interactions(spark, f"{tmp_path}/matrix").first().playcount == 2.0
    files.write_interactions_table(matrix, "matrix_table", 4)
    assert spark.table("matrix_table").count() == 1
    assert files.land(matrix, f"{tmp_path}/landed").count() == 1
    files.write_history(meta, f"{tmp_path}/history")
    assert spark.read.option("header", True).csv(f"{tmp_path}/history").first().name == "n"


def test_staged_payloads(spark, tmp_path):
    record = {"id": "s1", "href": "https://x/track/t1?z", "energy": 0.5, "tempo": 90.0, "danceability": 0.25}
    (tmp_path / "features").mkdir()
    (tmp_path / "features" / "a.json").write_text(json.dumps({"content": [record]}) + "\n{}\n")
    records = payloads.read_feature_records(spark, f"{tmp_path}/features")
    assert [(r.href, r.energy, r.key) for r in records.collect()] == [("https://x/track/t1?z", 0.5, None)]

    items = [
        {"id": "t0", "name": "No features", "artists": [{"name": "A"}]},
        {"id": "t1", "name": "Known", "artists": [{"name": "B"}, {"name": "C"}]},
        {"id": "t2", "name": "Nobody", "artists": []},
    ]
    (tmp_path / "top").mkdir()
    (tmp_path / "top" / "a.json").write_text(json.dumps({"items": items}))
    top = payloads.read_top_tracks(spark, f"{tmp_path}/top")
    assert sorted((r.pos, r.track_id, r.artist) for r in top.collect()) == [(0, "t0", "A"), (1, "t1", "B"), (2, "t2", None)]
    assert payloads.read_top_tracks(spark, f"{tmp_path}/top", 1).count() == 1
    report = reports.top_tracks_report(top, records).collect()
    assert [r.line for r in report] == ["2. B - Known | energy: 0.5, danceability: 0.25, tempo: 90.0"]

    (tmp_path / "search").mkdir()
    (tmp_path / "search" / "a.json").write_text(
        json.dumps({"request_id": 1, "tracks": {"items": items[1:]}})
        + "\n" + json.dumps({"request_id": 2, "tracks": {"items": []}})
        + "\n" + json.dumps({"request_id": 3})
    )
    hits = {r.request_id: (r.track_id, r.artist) for r in payloads.read_search_hits(spark, f"{tmp_path}/search").collect()}
    assert hits == {1: ("t1", "B"), 2: (None, None), 3: (None, None)}


def test_id_batches(spark):
    batches = payloads.id_batches(spark.range(85), "id").orderBy("batch_no").collect()
    assert [(b.batch_no, b.n_ids) for b in batches] == [(0, 40), (1, 40), (2, 5)]
    assert batches[2].ids == "80,81,82,83,84"


def test_parts_are_not_collected_on_the_driver(spark, tmp_path):
    parts = [(i, f"name {i}", "B", "T", i % 7, 1.0) for i in (1, 2, 2, 3)] + [(None, "none", "B", "T", 1, 1.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    vectors = [(i, [i + k / 10 for k in range(20)], i) for i in (1, 2, 4)] + [(3, None, 3), (None, [0.0] * 20, 5)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = star_tables.tracks(spark, str(tmp_path))
    rows = sorted(found.select("id", "name", "danceability", "energy", "key").collect(), key=str)
    assert [(r.id, r.key, r.danceability is None) for r in rows] == [(1, 1, False), (2, 2, False), (2, 2, False), (3, 3, True)]
    narrow = found.select("id", "danceability")
    assert "Broadcast" not in narrow._jdf.queryExecution().executedPlan().toString()
