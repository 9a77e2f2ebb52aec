from pyspark.sql import functions as F

from cadenza.operators import resolve


def tables(spark):
    tracks = spark.createDataFrame(
        [
            (1, "Africa", "['Toto']", 0.1),
            (2, "africa", "['Toto', 'Guest (UK)']", 0.2),
            (3, "Africa Unite", "['Bob']", 0.3),
            (4, "These Days", "[\"Nico's\"]", 0.4),
        ],
        "id long, name string, artists string, tempo double",
    )
    asked = spark.createDataFrame(
        [
            (10, "AFRICA", "toto"),
            (11, "africa", "guest (uk)"),
            (12, "these days", "nico"),
            (13, "Nowhere", "Nobody"),
            (14, "africa", ""),
            (15, "Elsewhere", "Known"),
            (16, "africa", "o', 'g"),
        ],
        "request_id long, title string, artist string",
    )
    return tracks, asked


def test_first_match_by_title_and_contained_artist(spark):
    tracks, asked = tables(spark)
    found = {r.request_id: r.track_id for r in resolve.first_matches(asked, tracks).collect()}
    assert found == {10: 1, 11: 2, 12: 4, 14: 1, 16: 2}


def test_resolution_falls_back_to_payloads_and_keeps_everyone(spark):
    tracks, asked = tables(spark)
    hits = spark.createDataFrame([(15, 77), (13, None), (10, 78)], "request_id long, track_id long")
    records = spark.createDataFrame([(77, None), (78, 9.0)], "track_id long, tempo double")
    out = {r.request_id: r for r in resolve.resolve(asked, tracks, ["tempo"], hits, records).collect()}
    assert len(out) == 7
    assert (out[15].status, out[15].track_id, out[15].tempo) == ("external", 77, 0.0)
    assert (out[13].status, out[13].tempo) == ("not_found", None)
    assert (out[10].status, out[10].tempo) == ("local", 0.1)
    alone = {r.request_id: r.status for r in resolve.resolve(asked, tracks, ["tempo"]).collect()}
    assert alone[15] == "not_found" and alone[10] == "local"


def test_numbered_matches_and_picks(spark):
    tracks, asked = tables(spark)
    listed = resolve.list_matches(asked, tracks)
    mine = sorted((r.match_no, r.track_id) for r in listed.collect() if r.request_id == 14)
    assert mine == [(1, 1), (2, 2), (3, 3)]
    picks = spark.createDataFrame([(14, 3), (10, 9)], "request_id long, pick long")
    chosen = {r.request_id: (r.track_id, r.in_range) for r in resolve.pick_match(listed, picks).collect()}
    assert chosen == {14: (3, True), 10: (None, False)}


def test_search_words(spark):
    tracks, _ = tables(spark)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(resolve.search_catalogue(tracks, "africa", "(uk")) == [2]
    assert ids(resolve.search_catalogue(tracks, "^africa$", "toto", regex=True)) == [1, 2]


def test_requests_of_the_same_words_share_one_list(spark, monkeypatch):
    tracks, _ = tables(spark)
    asked = [(i, "Africa", "o") for i in range(300)] + [(900, "africa", "toto"), (900, "unite", "bob"), (None, "these", "nico"), (901, None, "o")]
    asked = spark.createDataFrame(asked, "request_id long, title string, artist string")
    sizes = []
    plain = resolve.number_within
    monkeypatch.setattr(resolve, "number_within", lambda df, *a: sizes.append(df.count()) or plain(df, *a))
    found = sorted(((r.request_id, r.match_no, r.track_id) for r in resolve.list_matches(asked, tracks).collect()), key=str)
    want = [(i, n, n) for i in range(300) for n in (1, 2, 3)] + [(900, 1, 1), (900, 2, 2), (900, 3, 3), (None, 1, 4)]
    assert found == sorted(want, key=str)
    assert sizes == [3 + 3 + 1]  # not 900 and more
    picks = asked.select("request_id", F.lit(2).cast("long").alias("pick"))
    menu = resolve.list_matches(asked, tracks, only=picks)
    chosen = [(r.request_id, r.track_id, r.in_range) for r in resolve.pick_match(menu, picks).collect()]
    assert menu.count() == 301
    want = [(i, 2, True) for i in range(300)] + [(900, 2, True)] * 2 + [(None, None, False), (901, None, False)]
    assert sorted(chosen, key=str) == sorted(want, key=str)
