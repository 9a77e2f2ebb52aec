"""One listener's play export: counts, taste profile, candidates and a random-forest play predictor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import track_id_from_href
from cadenza.operators import forest
from cadenza.operators.clean import difference, drop_incomplete, first_per_key, stacked
from cadenza.operators.forest import Forest
from cadenza.operators.numbering import number_within
from cadenza.operators.sampling import sample_negatives
from cadenza.session import materialize

# Forest size and seed, songs kept, songs recommended, evaluation repeats.
TREES = 200
FOREST_SEED = 42
TOP_SONGS = 200
TOP_CANDIDATES = 20
REPEATS = 50


def play_counts(scrobbles: DataFrame) -> DataFrame:
    """Plays per (artist, track); rows without one of them are left out."""
    return (
        scrobbles.where(F.col("artist").isNotNull() & F.col("track").isNotNull())
        .groupBy("artist", "track")
        .agg(F.count("*").alias("count"))
    )


def top_songs(counts: DataFrame, n: int = TOP_SONGS) -> DataFrame:
    """The ``n`` most played songs; equal counts in order of artist and track."""
    return counts.orderBy(F.col("count").desc(), "artist", "track").limit(n)


def feature_table(records: DataFrame, features: list[str]) -> DataFrame:
    """Feature-service records keyed by the catalogue id found in their address."""
    if "spotify_id" not in records.columns:
        records = records.withColumn("spotify_id", track_id_from_href("href"))
    return first_per_key(records.select("spotify_id", *features), ["spotify_id"])


def with_features(songs: DataFrame, records: DataFrame, features: list[str]) -> DataFrame:
    """Songs with the features of their ``spotify_id``; songs without an id or a record keep NULLs."""
    return songs.join(feature_table(records, features), "spotify_id", "left")


def listener_history(
    scrobbles: DataFrame,
    search_hits: DataFrame,
    records: DataFrame,
    features: list[str],
    n: int = TOP_SONGS,
) -> DataFrame:
    """Most played songs with features: artist, track, count, spotify_id and the feature columns.

    ``search_hits`` has artist, track and spotify_id (NULL when the search found nothing).
    """
    songs = top_songs(play_counts(scrobbles), n)
    ids = first_per_key(search_hits.select("artist", "track", "spotify_id"), ["artist", "track"])
    return with_features(songs.join(ids, ["artist", "track"], "left"), records, features)


def taste_profile(history: DataFrame, features: list[str]) -> DataFrame:
    """Play-weighted mean of every feature, one row."""
    plays = F.sum("count")
    return history.agg(
        *[(F.sum(F.col(f).cast("double") * F.col("count")) / plays).alias(f) for f in features]
    )


def candidates(songs: DataFrame, history: DataFrame) -> DataFrame:
    """Catalogue songs the listener has not heard, by (artist, track)."""
    return difference(songs, history.select("artist", "track").distinct(), ["artist", "track"])


def training_rows(
    positives: DataFrame, unheard: DataFrame, features: list[str], seed: int
) -> DataFrame:
    """The heard songs plus as many unheard songs, drawn by seeded hash order, with count 0."""
    columns = ["artist", "track", *features, "count"]
    keyed = positives.select(*columns)
    negatives = sample_negatives(unheard, positives, ["id"], seed).withColumn("count", F.lit(0))
    return stacked(keyed, negatives.select("id", *columns))


def fit_forest(
    train: DataFrame,
    features: list[str],
    trees: int = TREES,
    seed: int = FOREST_SEED,
    max_depth: int = forest.DEEPEST,
) -> Forest:
    """Regression forest on ``count`` with exact splits that considers every feature at every split."""
    complete = drop_incomplete(train, features)
    if len(complete.select(F.lit(1)).take(2)) < 2:
        raise ValueError("a forest needs at least two training rows; with one it predicts one constant")
    key = [c for c in ("artist", "track", "id") if c in complete.columns]
    rows = complete.withColumn("run", F.lit(1)).withColumn("label", F.col("count"))
    rows = forest.numbered(rows.select("run", "label", *key, *features), [*key, "label", *features])
    return Forest(forest.grow(rows, features, trees, seed, max_depth), list(features), trees)


def constant_forest(song: DataFrame, features: list[str], trees: int = TREES) -> Forest:
    """The degenerate fit on a single song: every tree is one leaf, so every prediction is its count."""
    nodes = song.limit(1).select(
        F.lit(1).alias("run"), F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"), F.lit(1).cast("long").alias("node"),
        F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"),
        F.col("count").cast("double").alias("value"), F.lit(1).cast("long").alias("n"),
    )
    return Forest(materialize(nodes, "forest-nodes"), list(features), trees)


def squared_error(predicted: DataFrame) -> DataFrame:
    """One row with the mean squared error of ``predicted_count`` against ``count``."""
    gap = F.col("count") - F.col("predicted_count")
    return predicted.agg(F.avg(gap * gap).alias("mse"))


def _all_runs(
    positives: DataFrame, unheard: DataFrame | None, features: list[str], seeds: list[int], test_share: float
) -> DataFrame:
    """The rows of every run, with ``is_test``: what training_rows and split_exactly give for each seed."""
    runs = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("run"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)]))
    key = ["artist", "track"] if unheard is None else ["artist", "track", "id"]

    def hashed(rows: DataFrame, columns: list[str]) -> DataFrame:
        text = F.concat_ws("|", F.col("seed").cast("string"), *[F.col(c).cast("string") for c in columns])
        return rows.withColumn("_hash", F.md5(text))

    heard = materialize(positives.select("artist", "track", *features, F.col("count").alias("label")), "heard")
    rows = heard.withColumn("_run", runs).select("_run.run", "_run.seed", "*").drop("_run")
    if unheard is not None:
        wanted = heard.count()
        drawn = hashed(unheard.select("id", "artist", "track", *features).withColumn("_run", runs).select("_run.*", "*"), ["id"])
        nth = F.row_number().over(Window.partitionBy("run").orderBy("_hash", "id"))
        drawn = drawn.withColumn("_nth", nth).where(F.col("_nth") <= wanted).withColumn("label", F.lit(0))
        rows = rows.unionByName(drawn.drop("_run", "_hash", "_nth"), allowMissingColumns=True)
    ranked = number_within(hashed(drop_incomplete(rows, features), key), ["run"], ["_hash", *key], "_rank")
    ranked = materialize(ranked, "forest-ranked")
    sizes = ranked.groupBy("run").agg(F.ceil(F.lit(test_share) * F.count("*")).alias("_tests"))
    rows = ranked.join(sizes, "run").withColumn("is_test", F.col("_rank") <= F.col("_tests"))
    return rows.select("run", "seed", *key, *features, "label", "is_test")


def evaluate_forest(
    positives: DataFrame,
    unheard: DataFrame | None,
    features: list[str],
    repeats: int = REPEATS,
    trees: int = TREES,
    first_seed: int = 0,
    test_share: float = 0.2,
) -> tuple[DataFrame, Forest]:
    """Repeat sampling, splitting, fitting and scoring; returns (run, seed, mse) rows and the last forest.

    ``unheard=None`` trains on heard songs only (the comparison without negatives). All runs are one table: their
    samples, splits, trees and predictions come from the same jobs, however many runs there are.
    """
    seeds = [first_seed + i for i in range(repeats)]
    rows = materialize(_all_runs(positives, unheard, features, seeds, test_share), "forest-runs")
    key = ["artist", "track"] if unheard is None else ["artist", "track", "id"]
    train = forest.numbered(rows.where(~F.col("is_test")), key)
    fitted = Forest(forest.grow(train, features, trees, FOREST_SEED), list(features), trees)
    predicted = fitted.predict_runs(rows.where("is_test").withColumnRenamed("label", "count"))
    gap = F.col("count") - F.col("predicted_count")
    errors = predicted.groupBy("run").agg(F.avg(gap * gap).alias("mse"))
    known = positives.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(seeds)], "run int, seed int")
    table = known.join(errors, "run", "left")
    return materialize(table, "forest-errors"), fitted.of_run(repeats)


def error_summary(runs: DataFrame) -> DataFrame:
    """Mean MSE over all runs and its square root."""
    return runs.agg(F.avg("mse").alias("mse")).withColumn("rmse", F.sqrt("mse"))


def forest_recommendations(
    fitted: Forest, unheard: DataFrame, n: int = TOP_CANDIDATES
) -> DataFrame:
    """The ``n`` unheard songs with the highest predicted play count, compared at nine decimals."""
    return fitted.predict(unheard).orderBy(F.round("predicted_count", 9).desc(), "id").limit(n)


def usable_history(history: DataFrame, features: list[str]) -> DataFrame:
    """Heard songs whose features are all known."""
    return drop_incomplete(history, features)

