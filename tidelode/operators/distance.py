"""Distances of array columns: Euclidean as an expression, warping and matrix-profile in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelode.functions import kernels
from tidelode.schema import DataError


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Values of one side that a kernel gets at once.
PAIR_VALUES = 1 << 17


def _paired(kernel) -> callable:
    """kernel on stacked pairs, those of equal lengths together."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
        for size in np.unique(sizes, axis=0):
            at = np.flatnonzero((sizes == size).all(1))
            for part in np.array_split(at, -(-len(at) * max(1, int(size.max())) // PAIR_VALUES)):
                out[part] = kernel(*(np.array([v.iloc[i] for i in part], float) for v in (a, b)))
        return pd.Series(out)

    return run


def dtw(a: Column, b: Column, radius: int | None = None) -> Column:
    """Dynamic time warping distance, root of the least sum of squares; the arrays may differ in length.

    radius: only within so many places of the path of series of half the length, for long ones."""
    return _paired(kernels.dtw_pairs if radius is None else lambda x, y: kernels.dtw_near(x, y, radius))(a, b)


#: How a matrix profile is made; auto takes sliding for long series.
PROFILES = {"auto": kernels.profile, "brute": kernels.matrix_profile, "sliding": kernels.sliding_profile}


def mpdist(a: Column, b: Column, width: int | None = None, how: str = "auto") -> Column:
    """Mean absolute difference of two equally long series' matrix profiles."""
    of = PROFILES[how]
    return _paired(lambda x, y: kernels.mpdist_pairs(x, y, width, of))(a, b)


METRICS = {"euclidean": l2, "dtw": dtw, "mpdist": mpdist}


def matrix(rows: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every row to every center."""
    if metric == "euclidean":
        return np.sqrt(np.maximum(((rows[:, None] - centers[None]) ** 2).sum(2), 0))
    if metric == "dtw":
        return kernels.dtw(rows, centers)
    if metric == "mpdist":
        return kernels.mpdist(rows, centers)
    raise DataError(f"no such metric: {metric}")
