"""Published tables, the bucketed matrix, and containment through rare parts of texts."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import interactions, resolve
from cadenza.sources import files, landing


def test_only_whole_versions_are_read(spark, tmp_path):
    place = str(tmp_path / "table")
    rows = spark.createDataFrame([(1, "a,\"b\"\n"), (2, None), (None, "é")], "id long, name string")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|nothing has been published"):
        landing.published(spark, place)
    first = landing.publish(rows, place)
    assert sorted(map(str, first.collect())) == sorted(map(str, rows.collect()))
    rows.limit(1).write.parquet(f"{place}/versions/stray")  # a writer that died before its manifest
    assert landing.published(spark, place).count() == 3
    landing.publish(rows.where("id = 2"), place)
    assert [r.id for r in landing.published(spark, place).collect()] == [2]
    assert first.count() == 3  # who read the older version keeps it
    landing.publish(rows.limit(0), place)
    assert landing.published(spark, place).count() == 0


def test_values_that_do_not_survive_are_not_published(spark, tmp_path):
    place = str(tmp_path / "table")
    landing.publish(spark.createDataFrame([(1, "a")], "id long, name string"), place, "csv")
    broken = spark.createDataFrame([(2, "line\nbreak")], "id long, name string")
    with pytest.raises(ValueError, match="not published"):
        landing.publish(broken, place, "csv")
    assert [r.id for r in landing.published(spark, place).collect()] == [1]


def test_bucketed_matrix_is_not_moved(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 90).alias("track_id"), (F.col("id") % 77).alias("user_id"), F.lit(1.0).alias("playcount"))
    files.write_interactions_table(rows, "bucketed_matrix", 4, path=str(tmp_path / "matrix"))
    matrix = files.read_interactions_table(spark, "bucketed_matrix")
    reach = interactions.with_listener_reach(matrix)
    plan = reach._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert reach.count() == 4000 and {r.reach for r in reach.select("reach").distinct().collect()} == {51, 52}


def test_containment_equals_brute_force(spark):
    chance = random.Random(2)
    texts = ["".join(chance.choices("abcé .[", k=chance.randrange(0, 12))) for _ in range(300)] + [None, "x" * 5000]
    words = ["".join(chance.choices("abcé .[", k=chance.randrange(0, 6))) for _ in range(80)] + [None, "xxxx", "zzzz", ""]
    groups = "uv"
    t = {(chance.choice(groups), x) for x in texts if x is not None}
    w = {(chance.choice(groups), x) for x in words}
    found = resolve.containing(
        spark.createDataFrame(list(w), "g string, word string"), spark.createDataFrame(list(t), "g string, text string"), ["g"]
    )
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(g, word, text) for g, word in w for h, text in t if word is not None and g == h and word in text}


def test_staged_answers_are_pruned_and_malformed_ones_set_aside(spark, tmp_path):
    from cadenza.schema import SEARCH_PAYLOAD
    from cadenza.sources import payloads

    place = str(tmp_path / "staged")
    whole = '{"tracks": {"items": [{"id": "t%d", "name": "n", "artists": [{"name": "a"}]}]}}'
    rows = [(i, whole % i) for i in range(200)] + [(300, whole[:20]), (301, None), (302, ""), (303, "{}"), (304, "[1]")]
    payloads.stage(spark.createDataFrame(rows, "request_id long, body string"), place)
    good, malformed = payloads.staged(spark, place, SEARCH_PAYLOAD)
    assert {r.key for r in malformed.collect()} == {"300", "301", "302", "304"}
    hits = {r.key: r.track_id for r in payloads.search_hits(good).collect()}
    assert len(hits) == 201 and hits["17"] == "t17" and hits["303"] is None
    some, _ = payloads.staged(spark, place, SEARCH_PAYLOAD, keys=[17, 18])
    assert {r.key for r in some.collect()} == {"17", "18"}
    files_read = {f for f in some.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert 1 <= len(files_read) <= 2 < len(good.inputFiles())
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
