"""Windows over positions: sliding arrays, differences, running and rolling statistics, splits, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelode.operators.ordered import SERIES, framed, running
from tidelode.schema import EPS, YEAR, array_mean, array_std, let


def sliding(df: DataFrame, length: int, value: str = "value", target: bool = False) -> DataFrame:
    """(series_id, pos, window): the length values that end at each pos; target: also the next value."""
    cols = {"window": lambda w: F.collect_list(value).over(w.rowsBetween(-(length - 1), 0))}
    if target:
        cols["target"] = lambda w: F.lead(value).over(w)
    out = framed(df.select(SERIES, "pos", value), cols, before=length - 1, after=int(target))
    return out.where((F.col("pos") >= length - 1) & (F.size("window") == length)).drop(value)


def difference(df: DataFrame, value: str = "value", out: str = "diff") -> DataFrame:
    """x less the x before; 0 at first."""
    return framed(df, {out: lambda w: F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))}, before=1)


def cumulative(df: DataFrame, value: str = "returns", out: str = "equity") -> DataFrame:
    return running(df, out, F.col(value))


def drawdown(df: DataFrame, value: str = "returns", out: str = "drawdown") -> DataFrame:
    """The running sum less its running maximum."""
    e = running(df, "__equity", F.col(value))
    return running(e, "__peak", F.col("__equity"), "max").withColumn(out, F.col("__equity") - F.col("__peak")).drop("__equity", "__peak")


def rolling(df: DataFrame, value: str = "returns", window: int = YEAR) -> DataFrame:
    """df with rolling_sharpe, rolling_vol and rolling_return; null until the window is full."""

    frame = lambda w: w.rowsBetween(-(window - 1), 0)
    stats = {"__n": F.count(value), "__m": F.avg(value), "__s": F.stddev_samp(value)}
    out = framed(df, {n: (lambda w, c=c: c.over(frame(w))) for n, c in stats.items()}, before=window - 1)
    full = lambda c: F.when(F.col("__n") == window, c)
    return out.withColumns(
        {
            "rolling_sharpe": full(F.col("__m") / F.nullif(F.col("__s"), F.lit(0.0)) * YEAR**0.5),
            "rolling_vol": full(F.col("__s") * YEAR**0.5),
            "rolling_return": full(F.col("__m") * YEAR),
        }
    ).drop("__n", "__m", "__s")


def with_length(df: DataFrame, out: str = "length") -> DataFrame:
    """df with its series' number of positions."""
    return df.join(df.groupBy(SERIES).agg((F.max("pos") + 1).alias(out)), SERIES)


def split(df: DataFrame, share: float = 0.7) -> DataFrame:
    """df with part: train for the first share of each series' positions, else test."""
    n = with_length(df, "__n")
    return n.withColumn("part", F.when(F.col("pos") < F.floor(F.col("__n") * share), "train").otherwise("test")).drop("__n")


def folds(df: DataFrame, splits: int = 5) -> DataFrame:
    """A row for each row and fold it is in, with fold (0, 1, ...) and part: expanding train, then test."""
    n = with_length(df, "__n")
    size = F.floor(F.col("__n") / (splits + 1))
    n = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("__s", F.col("__n") - (splits - F.col("fold")) * size)
    part = F.when(F.col("pos") < F.col("__s"), "train").when(F.col("pos") < F.col("__s") + size, "test")
    return n.withColumn("part", part).where("part is not null").drop("__n", "__s")


def trend(window: Column, length: int) -> Column:
    """Each value's deviation from its moving average in standard deviations, clipped to -1 .. 1.

    The first length - 1 places take the first full average; all 0 in a shorter window."""
    start = lambda i: F.greatest(i - length + 1, F.lit(0))
    average = lambda i: array_mean(F.slice(window, start(i) + 1, F.lit(length)))
    clip = lambda z: F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0))
    at = let(array_std(window) + EPS, lambda sd: F.transform(window, lambda x, i: clip((x - average(i)) / sd)))
    return F.when(F.size(window) < length, F.transform(window, lambda x: F.lit(0.0))).otherwise(at)
