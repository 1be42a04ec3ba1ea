"""Bars: resampling, forward returns, alignment of a coarse series to a fine one without looking ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelode.operators.ordered import SERIES, framed
from tidelode.schema import DataError, from_micros, micros, need_columns, seconds


def resample(df: DataFrame, current: str | int, target: str | int, buffer: int = 0, on_grid: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """OHLCV bars of the target frequency from those of the current one.

    Bins start at each series' first timestamp plus buffer times current. on_grid drops rows that
    aren't a whole number of current periods after the first. Bins without rows don't appear."""
    step, width = seconds(current) * 1_000_000, seconds(target) * 1_000_000
    if width <= step:
        raise DataError("the target frequency must be longer than the current one")
    need_columns(df, SERIES, "ts", "open", "high", "low", "close", "volume")
    us = micros(F.col("ts"))
    first = df.groupBy(SERIES).agg(F.min(us).alias("__t0"))
    rows = df.withColumn("__us", us).join(first, SERIES)
    if on_grid:
        rows = rows.where((F.col("__us") - F.col("__t0")) % step == 0)
    return _binned(rows, width, buffer * step, ties)


def ticks_to_bars(df: DataFrame, target: str | int, ties: tuple[str, ...] = (), buffer_seconds: int = 0) -> DataFrame:
    """Bars of single prices (series_id, ts, value[, volume]); volume counts rows where there is none."""
    first = df.groupBy(SERIES).agg(F.min(micros(F.col("ts"))).alias("__t0"))
    volume = F.col("volume") if "volume" in df.columns else F.lit(1.0)
    prices = {c: F.col("value") for c in ("open", "high", "low", "close")}
    rows = df.withColumns(prices | {"volume": volume, "__us": micros(F.col("ts"))}).join(first, SERIES)
    return _binned(rows, seconds(target) * 1_000_000, buffer_seconds * 1_000_000, ties)


def _binned(rows: DataFrame, width: int, shift: int, ties: tuple[str, ...]) -> DataFrame:
    bin_ = F.floor((F.col("__us") - F.col("__t0") - shift) / F.lit(width))
    order = F.struct("__us", *ties)
    bars = rows.groupBy(SERIES, "__t0", bin_.alias("__bin")).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.select(SERIES, from_micros(F.col("__t0") + shift + F.col("__bin") * width).alias("ts"), "open", "high", "low", "close", "volume")


def forward_returns(df: DataFrame, price: str = "close") -> DataFrame:
    """df (with pos) with returns: the next price over this one less 1; 0 at the end, null on a zero price."""
    change = lambda w: F.when(F.lead("pos").over(w).isNull(), 0.0).otherwise(F.lead(price).over(w) / F.nullif(F.col(price), F.lit(0.0)) - 1)
    return framed(df, {"returns": change}, after=1)


def align(fine: DataFrame, coarse: DataFrame, step: str | int, value: str = "value", strict_tail: bool = False, bucket: str | int = "1h") -> DataFrame:
    """fine (series_id, ts, ...) with the last coarse value at least one fine step old; column ``aligned``.

    strict_tail leaves out each series' last coarse value and takes fine times down to the grid of
    steps from the series' first coarse time."""
    us, width = seconds(step) * 1_000_000, seconds(bucket) * 1_000_000
    c = coarse.select(SERIES, micros(F.col("ts")).alias("__us"), F.col(value).alias("__v"))
    f = fine.withColumn("__us", micros(F.col("ts")))
    if strict_tail:
        ends = c.groupBy(SERIES).agg(F.max("__us").alias("__last"), F.min("__us").alias("__grid"))
        c = c.join(ends, SERIES).where(F.col("__us") < F.col("__last")).select(SERIES, "__us", "__v")
        f = f.join(ends.select(SERIES, "__grid"), SERIES, "left")
        f = f.withColumn("__us", F.coalesce(F.col("__grid") + F.floor((F.col("__us") - F.col("__grid")) / us) * us, F.col("__us"))).drop("__grid")
    names = fine.columns
    both = c.select(SERIES, (F.col("__us") + us).alias("__at"), F.lit(0).alias("__src"), "__v", F.lit(None).cast(f.select(F.struct(*names)).schema[0].dataType).alias("__row"))
    both = both.unionByName(f.select(SERIES, F.col("__us").alias("__at"), F.lit(1).alias("__src"), F.lit(None).cast(coarse.schema[value].dataType).alias("__v"), F.struct(*names).alias("__row")))
    both = both.withColumn("__b", F.floor(F.col("__at") / width))
    # what a bucket leaves to the later ones
    left = both.where("__src = 0").groupBy(SERIES, "__b").agg(F.max_by("__v", "__at").alias("__c"))
    every = both.select(SERIES, "__b").distinct().join(left, [SERIES, "__b"], "left")
    earlier = Window.partitionBy(SERIES).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(SERIES, "__b", F.last("__c", ignorenulls=True).over(earlier).alias("__c"))
    inner = Window.partitionBy(SERIES, "__b").orderBy("__at", "__src").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__l", F.last("__v", ignorenulls=True).over(inner)).join(carried, [SERIES, "__b"])
    return both.where("__src = 1").select("__row.*", F.coalesce("__l", "__c").alias("aligned"))
