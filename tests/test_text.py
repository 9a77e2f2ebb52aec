from pyspark.sql import functions as F

from cadenza.functions import text


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


def test_capitalise_lowers_the_rest(spark):
    assert one(spark, "hELLO wORLD", text.capitalise("x")) == "Hello world"
    assert one(spark, "", text.capitalise("x")) == ""


def test_strip_keeps_null(spark):
    assert one(spark, " \t a b\n", text.strip("x")) == "a b"
    assert one(spark, None, text.strip("x")) is None


def test_first_artist_of_list_text(spark):
    cases = {
        "['A', 'B']": "A",
        "[\"B's\", 'C']": "B's",
        "['Guns (N)']": "Guns (N)",
        "[]": None,
        None: None,
        "plain": None,
        r"['it\'s \"x\"']": "it's \"x\"",
    }
    for value, expected in cases.items():
        assert one(spark, value, text.first_artist("x")) == expected, value


def test_artist_lines(spark):
    value = "['A', 'B']"
    assert one(spark, value, text.artists_line("x")) == "A, B"
    assert one(spark, value, text.artists_line("x", tidy=False)) == "A,  B"
    assert one(spark, value, text.by_line(F.lit(" Song "), F.col("x"))) == "\tSong by A, B"
    assert one(spark, "['Nico']", text.inner_text("x")) == "Nico"
    assert one(spark, "[]", text.inner_text("x")) == ""


def test_artist_contains_takes_the_word_literally(spark):
    assert one(spark, "['P (live)']", text.has_text("x", "(LIVE")) is True
    assert one(spark, "['P (live)']", text.has_text("x", r"\(l.ve\)", regex=True)) is True
    assert one(spark, "['P']", text.has_text("x", ".")) is False


def test_search_keys(spark):
    row = spark.createDataFrame([("T", "A")], "t string, a string").select(
        text.search_key("t", "a").alias("by"),
        text.search_key("t", "a", "dash").alias("dash"),
        text.search_key("t", None, "title").alias("title"),
    ).first()
    assert tuple(row) == ("T by A", "T - A", "T")


def test_cleaned_and_address(spark):
    assert one(spark, "Héllo, World-9!", text.cleaned("x")) == "hllo world9"
    assert one(spark, "https://a/track/4Sq?x=1", text.track_id_from_href("x")) == "4Sq"
    assert one(spark, "https://a/track/4Sq/more", text.track_id_from_href("x")) == "4Sq"
    assert one(spark, "https://a/album/4Sq", text.track_id_from_href("x")) is None
