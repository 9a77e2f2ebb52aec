"""k-means labels, the elbow table and a two-dimensional projection of the feature space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.scaling import fit_scaler
from cadenza.session import materialize, spread

# Clusters, restarts and iteration limit of the current model, largest k of the elbow sweep.
CLUSTERS = 5
RESTARTS = 10
MAX_ITERATIONS = 300
ELBOW_MAX = 19
#: A model is settled when no centre moves by more than this in one step.
SETTLED = 1e-9

Models = dict[tuple[int, int], np.ndarray]  # (k, restart) -> centres, one row each


def _points(catalogue: DataFrame, features: list[str]) -> DataFrame:
    """id and the standardised features z0, z1, ... of the complete rows, stored once, in parts for all tasks."""
    scaler = fit_scaler(catalogue, features)
    scaled = [s.alias(f"z{i}") for i, s in enumerate(scaler.all_scaled())]
    # Light rows that every scan meets with all models: merged by size alone, they would be one task's work.
    return materialize(spread(catalogue.na.drop(subset=features).select("id", *scaled), "id"), "points")


def starting_points(points: DataFrame, width: int, ks: list[int], restarts: int, seed: int) -> Models:
    """Per restart the rows that come first by a hash of (seed + restart, id); a model starts from its first k."""
    axes = [f"z{i}" for i in range(width)]
    drawn = points.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    drawn = drawn.withColumn("_hash", F.md5(F.concat_ws("|", (F.col("restart") + seed).cast("string"), F.col("id").cast("string"))))
    nth = F.row_number().over(Window.partitionBy("restart").orderBy("_hash", "id"))
    # At most restarts x largest k rows, whatever the catalogue holds.
    rows = drawn.withColumn("_nth", nth).where(F.col("_nth") <= max(ks)).orderBy("restart", "_nth").collect()
    first: dict[int, list] = {}
    for row in rows:
        first.setdefault(row["restart"], []).append([row[a] for a in axes])
    return {(k, r): np.array(found[:k], float) for r, found in first.items() for k in ks}


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (of equally near ones the first) and its squared distance."""
    away = np.zeros((len(x), len(centres)))
    for i in range(x.shape[1]):
        away += (x[:, i, None] - centres[None, :, i]) ** 2
    label = away.argmin(axis=1)
    return label, away[np.arange(len(x)), label]


def _step(points: DataFrame, width: int, models: Models) -> tuple[Models, dict[tuple[int, int], float]]:
    """One scan for all models: the means of the points nearest to each centre, and the inertia before the move."""
    axes = [f"z{i}" for i in range(width)]
    sums = [f"s{i}" for i in range(width)]

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {m: np.zeros((len(c), width + 2)) for m, c in models.items()}
        for frame in frames:
            x = frame[axes].to_numpy(float)
            for model, centres in models.items():
                label, away = _nearest(x, centres)
                k = len(centres)
                parts = [np.bincount(label, minlength=k), np.bincount(label, away, k)]
                totals[model] += np.column_stack(parts + [np.bincount(label, x[:, i], k) for i in range(width)])
        for (k, restart), total in totals.items():
            used = np.flatnonzero(total[:, 0])
            head = pd.DataFrame({"k": k, "restart": restart, "cluster": used}, index=range(len(used)))
            yield pd.concat([head, pd.DataFrame(total[used], columns=["n", "inertia", *sums])], axis=1)

    schema = "k int, restart int, cluster int, n double, inertia double, " + ", ".join(f"{s} double" for s in sums)
    found = points.select(*axes).mapInPandas(add_up, schema)
    found = found.groupBy("k", "restart", "cluster").agg(*[F.sum(c).alias(c) for c in ["n", "inertia", *sums]])
    moved, inertia = {m: c.copy() for m, c in models.items()}, dict.fromkeys(models, 0.0)
    for row in found.collect():  # one row per centre of the running models
        model = row["k"], row["restart"]
        moved[model][row["cluster"]] = [row[s] / row["n"] for s in sums]
        inertia[model] += row["inertia"]
    return moved, inertia


def fit_models(points: DataFrame, width: int, models: Models, max_iterations: int = MAX_ITERATIONS) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
    """(inertia, centres) of every model. All models that still move take part in each scan, the settled ones drop out.

    A centre that no point is nearest to stays where it is.
    """
    fitted: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
    running = dict(models)
    for _ in range(max_iterations):
        if not running:
            break
        moved, inertia = _step(points, width, running)
        for model in list(running):
            shift = np.sqrt(((moved[model] - running[model]) ** 2).sum(axis=1)).max(initial=0.0)
            if shift <= SETTLED:
                fitted[model] = inertia[model], running.pop(model)
            else:
                running[model] = moved[model]
    if running:
        _, inertia = _step(points, width, running)
        fitted |= {model: (inertia[model], centres) for model, centres in running.items()}
    return fitted


def best_restart(fitted: dict[tuple[int, int], tuple[float, np.ndarray]], k: int) -> tuple[float, np.ndarray]:
    """Lowest inertia at six decimals, of equal ones the first restart."""
    model = min((m for m in fitted if m[0] == k), key=lambda m: (round(fitted[m][0], 6), m[1]))
    return fitted[model]


def cluster_tracks(
    catalogue: DataFrame,
    features: list[str],
    k: int = CLUSTERS,
    restarts: int = RESTARTS,
    seed: int = 64,
) -> DataFrame:
    """Catalogue with a ``cluster`` column from standardised features; NULL for a track that lacks one."""
    points = _points(catalogue, features)
    models = starting_points(points, len(features), [k], restarts, seed)
    _, centres = best_restart(fit_models(points, len(features), models), k)
    scaler = fit_scaler(catalogue, features)
    away = [
        sum(((scaler.scaled(f) - F.lit(float(c[i]))) * (scaler.scaled(f) - F.lit(float(c[i]))) for i, f in enumerate(features)), F.lit(0.0))
        for c in centres
    ]
    label = F.array_position(F.array(*away), F.least(*away) if len(away) > 1 else away[0]) - 1
    return catalogue.withColumn("cluster", label.cast("int"))


def elbow_table(
    catalogue: DataFrame,
    features: list[str],
    largest_k: int = ELBOW_MAX,
    restarts: int = RESTARTS,
    seed: int = 64,
) -> DataFrame:
    """Lowest inertia per k = 1..``largest_k``; all models of all restarts are fitted by the same scans."""
    points = _points(catalogue, features)
    ks = list(range(1, largest_k + 1))
    fitted = fit_models(points, len(features), starting_points(points, len(features), ks, restarts, seed))
    rows = [(k, float(best_restart(fitted, k)[0])) for k in ks]
    return catalogue.sparkSession.createDataFrame(rows, "k int, inertia double")


def principal_axes(covariance: np.ndarray, n: int, sweeps: int = 100) -> np.ndarray:
    """The ``n`` eigenvectors of the largest eigenvalues, one per row, by Jacobi rotations.

    Sign rule: the coefficient of largest size, of equal ones the first, is positive.
    """
    a, v = covariance.astype(float).copy(), np.eye(len(covariance))
    for _ in range(sweeps):
        off = np.abs(a - np.diag(np.diag(a)))
        if off.max(initial=0.0) <= 1e-15 * max(np.abs(np.diag(a)).max(initial=0.0), 1e-300):
            break
        for p in range(len(a)):
            for q in range(p + 1, len(a)):
                if a[p, q] == 0:
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.sqrt(theta * theta + 1))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.eye(len(a))
                turn[[p, q], [p, q]], turn[p, q], turn[q, p] = c, t * c, -t * c
                a, v = turn.T @ a @ turn, v @ turn
    axes = v[:, np.argsort(-np.diag(a), kind="stable")[:n]].T
    lead = np.abs(np.round(axes, 12)).argmax(axis=1)
    return axes * np.sign(axes[np.arange(len(axes)), lead])[:, None]


def project_2d(catalogue: DataFrame, features: list[str]) -> DataFrame:
    """Two principal components of the centred, unscaled features: id, pc1, pc2.

    One pass takes the means and the co-moments, which Spark merges across partitions already centred; only
    that small matrix reaches the driver. Tracks that lack a feature are left out.
    """
    complete = catalogue.na.drop(subset=features)
    numbers = [F.col(f).cast("double") for f in features]
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    row = complete.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(numbers)],
        *[F.covar_pop(numbers[i], numbers[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    if row["m0"] is None:
        return complete.select("id", F.lit(0.0).alias("pc1"), F.lit(0.0).alias("pc2"))
    covariance = np.zeros((len(features), len(features)))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = row[f"c{i}_{j}"]
    axes = principal_axes(covariance, 2)
    along = [
        sum(((x - F.lit(row[f"m{i}"])) * F.lit(float(axis[i])) for i, x in enumerate(numbers)), F.lit(0.0)) for axis in axes
    ]
    return complete.select("id", along[0].alias("pc1"), along[1].alias("pc2"))
