"""Reducers: a window (array of numbers) to a few numbers.

They are numpy kernels over the whole Arrow batch of equally long windows (a Fourier transform of nested
array expressions took four times as long); movement vectors carry state along a series.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelode.functions import kernels
from tidelode.operators.ordered import SERIES
from tidelode.schema import MOVEMENT, DataError, let


class DistanceMeasure(Enum):
    EUCLIDEAN = 1
    PERPENDICULAR = 2
    VERTICAL = 3


def check_window(df: DataFrame, column: str, least: int) -> DataFrame:
    """df without windows of fewer values."""
    return df.where(F.size(column) >= least)


def _batched(kernel: Callable[[np.ndarray], np.ndarray], column: Column) -> Column:
    """kernel on stacked windows, those of each length together."""

    @F.pandas_udf("array<double>")
    def run(windows: pd.Series) -> pd.Series:
        out = np.empty(len(windows), object)
        sizes = np.array([-1 if w is None else len(w) for w in windows])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size >= 0:
                for i, row in zip(at, kernel(np.array([windows.iloc[i] for i in at], float).reshape(len(at), size)), strict=True):
                    out[i] = row
        return pd.Series(out)

    return run(column)


def fft(window: Column, n: int) -> Column:
    """The n largest magnitudes of the discrete Fourier transform, by ascending frequency."""
    return _batched(lambda x: kernels.top(np.abs(np.fft.fft(x, axis=1)), n), window)


def wavelet(window: Column, n: int, name: str = "coif1") -> Column:
    """The n largest coefficients of the multilevel transform, signed, in their order."""
    return _batched(lambda x: kernels.top(kernels.wavedec(x, name), n), window)


def fft_wavelet(window: Column, n: int, name: str = "db1") -> Column:
    """n // 2 Fourier magnitudes, then n - n // 2 wavelet coefficients."""
    if n < 2:
        raise DataError("fft_wavelet needs two components at least")
    return F.concat(fft(window, n // 2), wavelet(window, n - n // 2, name))


def pip(window: Column, n: int, measure: DistanceMeasure = DistanceMeasure.EUCLIDEAN) -> Column:
    """The values of the n perceptually important points, in order."""
    return _batched(lambda x: np.take_along_axis(x, kernels.important_points(x, n, measure.value), 1), window)


def pivots(window: Column, n: int, min_movement: float = 0.001) -> Column:
    """Places of up to n pivots by deviation from the chord; segments of little net movement aren't cut."""
    places = _batched(lambda x: kernels.pivot_places(x, n, min_movement), window)
    return F.filter(places, lambda p: p >= 0).cast("array<int>")


def movement_features(window: Column, n: int, min_movement: float = 0.001) -> Column:
    """Raw movement features, eight for each segment between n pivots: array<array<double>>."""
    width = len(MOVEMENT)

    def run(x: np.ndarray) -> np.ndarray:
        return kernels.movement_rows(x, kernels.pivot_places(x, n, min_movement)).reshape(len(x), -1)

    flat = F.filter(_batched(run, window), lambda v: v.isNotNull() & ~F.isnan(v))  # pandas makes nan null
    cut = lambda v: F.transform(F.sequence(F.lit(0), (F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, width))
    return let(flat, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.expr("cast(array() as array<array<double>>)")))


def pack(vectors: Column, n: int) -> Column:
    """Flattened, cut or padded with zeros to n numbers."""
    flat = F.flatten(vectors)
    return F.slice(F.concat(flat, F.array_repeat(F.lit(0.0), n)), 1, n)


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list array."""
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), np.ascontiguousarray(rows).reshape(-1))


_RAW = "series_id string, pos long, part long, place long, stats array<double>, raw array<double>"
#: Chunks before its own whose statistics a chunk's carry is made of; what came before them has faded.
_CARRIED = 16


def movement_vectors(
    df: DataFrame, n_pivots: int, features: tuple[str, ...] | None = None, normalize_window: int = 100, lookback: int = 10,
    min_movement: float = 0.001, trend_window: int = 20, alpha: float = 0.1, column: str = "window", chunk: int = 4096,
) -> DataFrame:
    """(series_id, pos, features) of windows in order: statistics of earlier windows normalise each one.

    Each chunk of a series works out its windows' segments and, from 0, the exponential means of its statistics, with as many
    windows before it as their history and magnitudes look back. An exponential mean over a chunk is an affine map
    of what it begins with, (decay, sum); maps of chunks compose to each chunk's beginning, which is then
    added to its rows. Chunks are long enough that _CARRIED of them leave nothing of what came before."""
    settings = dict(n=n_pivots, features=features, normalize_window=normalize_window, lookback=lookback, min_movement=min_movement, trend_window=trend_window, alpha=alpha)
    state = kernels.MovementState(**settings)  # checks the settings
    names, n_segments = state.names, state.segments
    halo = max(normalize_window, lookback - 1, 1)
    chunk = max(chunk, halo, int(np.ceil(np.log(1e-18) / np.log(1 - alpha) / _CARRIED)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["pos"])).combine_chunks()
        pos, part = table["pos"].to_numpy(), key[1].as_py()
        x = np.asarray(pc.list_flatten(table[column]), float).reshape(len(pos), -1)
        own = np.flatnonzero(pos // chunk == part)
        raw = kernels.raw_movements(x, n_segments, min_movement, trend_window, normalize_window)
        raw = np.stack([raw[f] for f in names], axis=2)[own].reshape(len(own), n_segments * len(names))
        stats = kernels.fade(kernels.window_stats(x, lookback, normalize_window)[own], alpha)
        series = pa.array([key[0].as_py()] * len(own), pa.string())
        columns = [series, pos[own], np.full(len(own), part, np.int64), np.arange(1, len(own) + 1), _lists(stats), _lists(raw)]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[f.split()[0] for f in _RAW.split(", ")])

    at = F.expr(f"pos div {chunk}")
    spots = F.array_compact(F.array(at, F.when(F.col("pos") % chunk >= chunk - halo, at + 1)))
    spread = df.select(SERIES, "pos", column, F.explode(spots).alias("__c"))
    rows = spread.groupBy(SERIES, "__c").applyInArrow(run, _RAW)

    order = Window.partitionBy(SERIES).orderBy("part")  # a row for each chunk
    ends = rows.groupBy(SERIES, "part").agg(F.max("place").alias("n"), F.max_by("stats", "place").alias("end"))
    ends = ends.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = F.collect_list(F.struct("upto", "end")).over(order.rowsBetween(-_CARRIED, -1))
    start = F.col("upto") - F.col("n")
    left = lambda n: F.pow(F.lit(1 - alpha), n)
    begun = F.transform(F.lit(list(kernels.START)), lambda v: v * left(start))
    carry = F.aggregate(earlier, begun, lambda acc, e: F.zip_with(acc, e["end"], lambda a, b: a + b * left(start - e["upto"])))
    rows = rows.join(ends.select(SERIES, "part", carry.alias("carry")), [SERIES, "part"])
    stats = F.zip_with("stats", "carry", lambda a, b: a + b * left(F.col("place")))
    stat = {name: F.col("__s")[i] for i, name in enumerate(kernels.STATS)}
    normal = {
        "vertical": lambda v: (v - stat["price_mean"]) / stat["price_std"],
        "speed": lambda v: (v - stat["speed_mean"]) / stat["speed_std"],
        "volatility": lambda v: v / stat["volatility_std"],
    }
    each = [normal.get(name, lambda v: v)(F.col("raw")[k * len(names) + j]) for k in range(n_segments) for j, name in enumerate(names)]
    packed = F.array(*[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in each])
    return rows.withColumn("__s", stats).select(SERIES, "pos", packed.alias("features"))


def movement_importance(vectors: DataFrame, column: str = "movement") -> DataFrame:
    """(feature, importance): each feature's share of the variances over all movements (array<double> of 8)."""
    each = vectors.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v"))
    total = each.agg(F.sum("v").alias("t"))
    names = F.element_at(F.array(*[F.lit(m) for m in MOVEMENT]), F.col("i") + 1)
    return each.join(F.broadcast(total)).select(names.alias("feature"), F.when(F.col("t") > 0, F.col("v") / F.col("t")).otherwise(0.0).alias("importance"))


#: Reducers of one's own: name to a function of (window column, n) that returns an array column.
CUSTOM: dict[str, Callable[[Column, int], Column]] = {}


def register(name: str, reduce: Callable[[Column, int], Column]) -> None:
    CUSTOM[name] = reduce


def reducer(kind: str, n: int, wavelet_name: str = "coif1", measure: DistanceMeasure = DistanceMeasure.EUCLIDEAN, **movement) -> Callable[[DataFrame], DataFrame]:
    """DataFrame of windows to DataFrame of features, by name: PIP, FFT, Wavelet, FFTWavelet, MVR."""
    column = {
        "PIP": lambda: pip(F.col("window"), n, measure),
        "FFT": lambda: fft(F.col("window"), n),
        "Wavelet": lambda: wavelet(F.col("window"), n, wavelet_name),
        "FFTWavelet": lambda: fft_wavelet(F.col("window"), n, wavelet_name),
    }
    if kind == "MVR":
        return lambda df: movement_vectors(df, n, **movement)
    if kind in CUSTOM:
        column[kind] = lambda: CUSTOM[kind](F.col("window"), n)
    if kind not in column:
        raise DataError(f"no such reducer: {kind}")
    return lambda df: check_window(df, "window", n).select(SERIES, "pos", column[kind]().alias("features"))
