from cadenza.operators import clean, numbering, sampling


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_first_row_per_key_wins(spark):
    df = spark.createDataFrame(
        [("u", "t", 5, 2), ("u", "t", 9, 1), ("u", "s", 3, 3)],
        "user_id string, track_id string, playcount int, line int",
    )
    kept = clean.first_per_key(df, ["user_id", "track_id"], ["line"])
    assert rows(kept, "track_id", "playcount") == [("s", 3), ("t", 9)]


def test_catalogue_is_deduplicated_before_gaps_are_dropped(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 2, 1.0), ("b", 1, 2.0), ("c", 1, nan)], "id string, line int, tempo double"
    )
    assert rows(clean.clean_catalogue(df, ["line"]), "id", "tempo") == [("b", 2.0)]


def test_fill_and_headers(spark):
    df = spark.createDataFrame([(None, 1)], " Tempo string, ARTIST int".replace(" Tempo", "`Tempo `"))
    assert clean.tidy_headers(df).columns == ["tempo", "artist"]
    gaps = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    assert rows(clean.fill_missing(gaps, ["a", "b"]), "a", "b") == [(0.0, 0.0)]


def test_category_codes_follow_sorted_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "user_id string")
    assert sorted(
        (r.user_id or "", r.user_id_code) for r in clean.encode_category(df, "user_id").collect()
    ) == [("", -1), ("a", 0), ("b", 1), ("b", 1)]


def test_lookup_reports_missing_keys(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "track_id int")
    details = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "track_id int, name string")
    assert rows(clean.lookup(keys, details, "track_id"), "track_id", "name") == [(1, "x"), (2, "z")]
    assert rows(clean.missing_keys(keys, details, "track_id"), "track_id") == [(3,)]


def test_counts_put_back_on_rows_and_folded(spark):
    df = spark.createDataFrame([("m", 2), ("m", 1), (None, 3)], "track_mbid string, n int")
    counted = clean.with_group_count(df, "track_mbid")
    assert sorted((r.n, r["count"]) for r in counted.collect() if r.track_mbid) == [(1, 2), (2, 2)]
    folded = clean.one_row_with_count(df, "track_mbid", ["n"])
    assert rows(folded, "track_mbid", "n", "count") == [("m", 1, 2)]


def test_difference_keeps_duplicates(spark):
    a = spark.createDataFrame([("x", "s", 1), ("x", "s", 1), ("y", "t", 2)], "artist string, track string, n int")
    b = spark.createDataFrame([("y", "t")], "artist string, track string")
    assert len(clean.difference(a, b, ["artist", "track"]).collect()) == 2


def test_row_numbers_over_many_parts(spark):
    df = spark.range(0, 1000, numPartitions=7).selectExpr("(id * 37) % 1000 as v", "id % 3 as g")
    numbered = numbering.number_rows(df, ["v"], "no").collect()
    assert sorted((r.no, r.v) for r in numbered) == [(i + 1, i) for i in range(1000)]
    within = numbering.number_within(df, ["g"], ["v"], "no").collect()
    for g in range(3):
        mine = sorted((r.v, r.no) for r in within if r.g == g)
        assert [no for _, no in mine] == list(range(1, len(mine) + 1))


def test_split_and_sample_have_exact_sizes(spark):
    df = spark.range(0, 103)
    split = sampling.split_exactly(df, ["id"], 0.2, 64).collect()
    assert sum(r.is_test for r in split) == 21 and len(split) == 103
    sample = sampling.sample_exactly(df, ["id"], 17, 5).collect()
    assert len({r.id for r in sample}) == 17
    again = sampling.sample_exactly(df.repartition(9), ["id"], 17, 5).collect()
    assert {r.id for r in sample} == {r.id for r in again}
    few = sampling.sample_negatives(df, df.limit(4), ["id"], 1)
    assert few.count() == 4
    assert sampling.sample_fraction(df, 0.5, 1).count() == sampling.sample_fraction(df, 0.5, 1).count()
