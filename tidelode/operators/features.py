"""Feature rows (series_id, pos, features): row z-scores and removal of consecutive repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelode.operators.ordered import framed
from tidelode.schema import EPS, array_mean, array_std, let


def zscore(v: Column) -> Column:
    """(x - mean) / (population standard deviation + EPS)."""
    stats = F.struct(array_mean(v).alias("m"), (array_std(v) + EPS).alias("s"))
    return let(stats, lambda t: F.transform(v, lambda x: (x - t["m"]) / t["s"]))


def zscore_rows(df: DataFrame, column: str = "features") -> DataFrame:
    """df with the column's arrays standardised."""
    return df.withColumn(column, zscore(F.col(column)))


def drop_repeats(df: DataFrame, n: int, column: str = "features") -> DataFrame:
    """Rows whose inner coordinates differ from those of the row at the position before.

    All coordinates count if there are two or fewer."""
    inner = F.slice(column, 2, n - 2) if n > 2 else F.col(column)
    new = lambda w: ~F.coalesce(F.lag(inner).over(w) == inner, F.lit(False))
    return framed(df, {"__new": new}, before=1).where("__new").drop("__new")


def transform_windows(df: DataFrame, reducer, n: int) -> DataFrame:
    """Windows to features: reduce, drop repeats, standardise; pos tells which windows are left."""
    return reducer(df).transform(drop_repeats, n).transform(zscore_rows)
