"""Three recommenders answer one table of (title, artist) requests."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import strip
from cadenza.operators.collaborative import collaborative_recommendations
from cadenza.operators.recommend import cosine_recommendations, knn_recommendations
from cadenza.operators.resolve import NOT_FOUND
from cadenza.operators.scaling import fit_scaler
from cadenza.session import materialize

KNN, COSINE, COLLABORATIVE = "knn", "cosine", "collaborative"

_COLUMNS = ["request_id", "model", "rank", "track_id", "name", "artist", "score", "line"]


def _tagged(df: DataFrame, model: str, artist: str) -> DataFrame:
    return (
        df.withColumn("model", F.lit(model))
        .withColumn("artist", F.col(artist))
        .withColumn("track_id", F.col("track_id").cast("string"))
        .select(*_COLUMNS)
    )


def ensemble_recommendations(
    resolved: DataFrame,
    catalogue: DataFrame,
    interactions: DataFrame,
    metadata: DataFrame,
    features: list[str],
    n: int = 3,
) -> DataFrame:
    """``n`` recommendations per request and model, in one table; repeats across models are kept.

    ``resolved`` comes from ``resolve``. Requests without features get no rows from any model.
    """
    found = materialize(resolved.where(F.col("status") != NOT_FOUND), "resolved")
    scaler = fit_scaler(catalogue, features)
    with ThreadPoolExecutor(max_workers=3) as pool:  # the models do not depend on each other
        near_job = pool.submit(knn_recommendations, found, catalogue, features, n, scaler=scaler)
        alike_job = pool.submit(cosine_recommendations, found, catalogue, features, n, scaler=scaler)
        shared_job = pool.submit(
            collaborative_recommendations,
            found.select("request_id", "title", "artist"),
            interactions,
            metadata,
            n,
        )
        near, alike, shared = near_job.result(), alike_job.result(), shared_job.result()
    near = near.withColumn("line", strip("line"))
    return (
        _tagged(near, KNN, "artists")
        .unionByName(_tagged(alike, COSINE, "artists"))
        .unionByName(_tagged(shared, COLLABORATIVE, "artist"))
    )
