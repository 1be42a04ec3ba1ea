"""Clustering: k-means fits, nearest centers, sequential k-means with other metrics, signals from distances.

Centers are k short arrays in the driver's memory; rows never leave the executors but for them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.operators import distance
from tidelode.schema import DataError, let

SEED = 14


def _sorted_centers(centers) -> list[list[float]]:
    return sorted([float(x) for x in c] for c in centers)


def fit_kmeans(df: DataFrame, k: int, column: str = "features", seed: int = SEED, max_iter: int = 300) -> list[list[float]]:
    """Centers in lexicographic order, so that cluster numbers don't depend on the run."""
    rows = df.select(array_to_vector(F.col(column)).alias("features"))
    return _sorted_centers(KMeans(k=k, seed=seed, maxIter=max_iter).fit(rows).clusterCenters())


def centers_table(spark: SparkSession, centers: list[list[float]]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(centers)), "cluster int, center array<double>")


def _literal(centers: list[list[float]]) -> Column:
    return F.lit(np.array(centers, float).ravel().tolist())


def distances(column: Column, centers: list[list[float]]) -> Column:
    """The Euclidean distances to all centers, an array."""
    d = len(centers[0])
    flat = _literal(centers)
    return F.transform(F.sequence(F.lit(0), F.lit(len(centers) - 1)), lambda i: distance.l2(column, F.slice(flat, i * d + 1, d)))


def _other_distances(centers: list[list[float]], metric: str):
    c = np.array(centers, float)

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(list(distance.matrix(np.array(rows.tolist(), float), c, metric))) if len(rows) else pd.Series([], dtype=object)

    return run


def assign(df: DataFrame, centers: list[list[float]], column: str = "features", metric: str = "euclidean", out: str = "cluster") -> DataFrame:
    """df with the nearest center's number (the first, of equally near ones) and its distance."""
    d = distances(F.col(column), centers) if metric == "euclidean" else _other_distances(centers, metric)(F.col(column))
    df = df.withColumn("__d", d)
    least = F.array_min("__d")
    return df.withColumn(out, (F.array_position("__d", least) - 1).cast("int")).withColumn("distance", least).drop("__d")


def assign_by_fold(df: DataFrame, centers: list[list[list[float]]], column: str = "features", fold: str = "fold") -> DataFrame:
    """df with the nearest of its fold's centers (by Euclidean distance), numbered fold * k + center, and its distance."""
    k, d = len(centers[0]), len(centers[0][0])
    flat = F.element_at(F.lit([np.array(c, float).ravel().tolist() for c in centers]), F.col(fold) + 1)
    each = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: distance.l2(F.col(column), F.slice("__f", i * d + 1, d)))
    df = df.withColumn("__f", flat).withColumn("__d", each)
    least = F.array_min("__d")
    number = F.col(fold) * k + F.array_position("__d", least) - 1
    return df.withColumns({"cluster": number.cast("int"), "distance": least}).drop("__f", "__d")


def fit_folds(df: DataFrame, k: int, folds: int, column: str = "features", fold: str = "fold", max_iter: int = 100, seed: int = SEED, tol: float = 1e-8) -> list[list[list[float]]]:
    """Centers for each fold of df (fold, features): every pass seeds, or moves, those of all folds at once.

    Seeds are drawn as in seed_centers; only a row for each fold and center reaches the driver."""
    rows = df.select(fold, column).persist()
    try:
        hashed = F.xxhash64(column, F.lit(seed))
        first = dict(rows.groupBy(fold).agg(F.min_by(column, F.struct(hashed, F.col(column)))).collect())
        if missing := [f for f in range(folds) if f not in first]:
            raise DataError(f"no rows to cluster in folds {missing}")
        centers = [[list(first[f])] for f in range(folds)]
        for i in range(1, k):
            u = (F.pmod(F.xxhash64(column, F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
            race = F.when(F.col("distance") > 0, -F.log(u) / (F.col("distance") * F.col("distance")))
            drawn = assign_by_fold(rows, centers, column, fold).where(race.isNotNull()).groupBy(fold).agg(F.min_by(column, F.struct(race, F.col(column))))
            found = dict(drawn.collect())
            centers = [[*c, list(found.get(f, c[-1]))] for f, c in enumerate(centers)]
        for _ in range(max_iter):
            new = [[list(c) for c in of] for of in centers]
            for number, center in update_centers(assign_by_fold(rows, centers, column, fold), column).collect():
                new[number // k][number % k] = list(center)
            done = np.allclose(new, centers, atol=tol)
            centers = new
            if done:
                break
    finally:
        rows.unpersist()
    return [_sorted_centers(c) for c in centers]


def update_centers(assigned: DataFrame, column: str = "features", cluster: str = "cluster") -> DataFrame:
    """(cluster, center): the mean of each cluster's rows; one aggregation by cluster and coordinate."""
    each = assigned.select(cluster, F.posexplode(column).alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))


def seed_centers(df: DataFrame, k: int, column: str = "features", metric: str = "euclidean", seed: int = SEED) -> list[list[float]]:
    """k-means++: each next center is drawn with probability by the squared distance to the nearest one.

    The draw is exponential-race sampling by a hash of the row: one pass and one row for each center."""
    first = df.orderBy(F.xxhash64(column, F.lit(seed)), column).select(column).first()
    if first is None:
        raise DataError("no rows to cluster")
    centers = [list(first[0])]
    for i in range(1, k):
        d = assign(df.select(column), centers, column, metric)
        u = (F.pmod(F.xxhash64(column, F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        drawn = d.where("distance > 0").orderBy(-F.log(u) / (F.col("distance") * F.col("distance")), column).select(column).first()
        centers.append(list(drawn[0]) if drawn else list(centers[-1]))
    return centers


def fit_sequential(df: DataFrame, k: int, column: str = "features", metric: str = "euclidean", max_iter: int = 100, seed: int = SEED, tol: float = 1e-8, start: list[list[float]] | None = None) -> list[list[float]]:
    """Lloyd's iterations for any metric, from start or from drawn centers; an empty cluster keeps its center."""
    if len(df.limit(k).take(k)) < k:
        raise DataError(f"fewer rows than {k} clusters")
    df = df.select(column).persist()
    try:
        centers = start or seed_centers(df, k, column, metric, seed)
        for _ in range(max_iter):
            new = [list(c) for c in centers]
            for cluster, center in update_centers(assign(df, centers, column, metric), column).collect():  # k rows
                new[cluster] = list(center)
            done = np.allclose(new, centers, atol=tol)
            centers = new
            if done:
                break
    finally:
        df.unpersist()
    return centers


def fit(
    df: DataFrame, k: int, model: str = "standard", metric: str = "euclidean", column: str = "features", seed: int = SEED, start: list[list[float]] | None = None, max_iter: int | None = None
) -> list[list[float]]:
    """standard and ts are k-means; sequential takes any metric, and centers to start from."""
    if start is not None and model != "sequential":
        raise DataError("only the sequential model starts from given centers")
    if model in ("standard", "ts"):
        return fit_kmeans(df, k, column, seed, 300 if max_iter is None else max_iter)
    if model == "sequential":
        return fit_sequential(df, k, column, metric, 100 if max_iter is None else max_iter, seed, start=start)
    raise DataError(f"no such model: {model}")


def probabilities(d: Column) -> Column:
    """Softmax of negative distances."""

    def scaled(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))

    nearest = lambda v: let(F.array_min(v), lambda m: F.transform(v, lambda x: F.exp(m - x)))
    return let(d, lambda v: let(nearest(v), scaled))


def _share(p: Column, clusters: list[int]) -> Column:
    if not clusters:
        return F.lit(0.0)
    return F.aggregate(F.filter(p, lambda x, i: i.isin(clusters)), F.lit(0.0), lambda a, x: a + x)


def signal(p: Column, long: list[int], short: list[int], threshold: float = 0.6) -> tuple[Column, Column]:
    """(signal, confidence): a side whose probabilities sum to more than the threshold and the other side's."""
    up, down = _share(p, long), _share(p, short)
    is_up, is_down = (up > threshold) & (up > down), (down > threshold) & (down > up)
    side = F.when(is_up, 1).when(is_down, -1).otherwise(0)
    return side, F.when(is_up, up).when(is_down, down).otherwise(F.greatest(1 - (up + down), F.lit(0.0)))


def signals(df: DataFrame, centers: list[list[float]], long: list[int], short: list[int], column: str = "features") -> DataFrame:
    """df of features with signal and confidence."""
    df = df.withColumn("__p", probabilities(distances(F.col(column), centers)))
    side, sure = signal(F.col("__p"), long, short)
    return df.withColumns({"signal": side, "confidence": sure}).drop("__p")


def importance(weights: list[float]) -> list[float]:
    total = sum(map(abs, weights))
    return [abs(w) / total if total else 0.0 for w in weights]

