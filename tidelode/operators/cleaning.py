"""Cleaning of raw bars: nulls, time zones, rounding, date ranges, outliers, volume, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelode.operators.ordered import SERIES, framed, number_rows
from tidelode.schema import PRICES, DataError, from_micros, micros, seconds


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows whose four prices are there and are numbers."""
    ok = F.lit(True)
    for c in PRICES:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(ok)


def parse_time(df: DataFrame, column: str = "time") -> DataFrame:
    """ts from a column of times or of text; what is no time becomes null and goes."""
    kind = dict(df.dtypes)[column]
    t = F.try_to_timestamp(F.col(column)) if kind == "string" else F.col(column)
    return df.withColumn("ts", t.cast("timestamp_ntz")).where("ts is not null")


def convert_zone(df: DataFrame, source: str, target: str, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.convert_timezone(F.lit(source), F.lit(target), F.col(ts)))


def rounded(ts: Column, frequency: str | int) -> Column:
    """ts to the nearest multiple of the frequency since 1970, halves to the even one."""
    w = seconds(frequency) * 1_000_000
    us = micros(ts)
    q = F.floor(us / F.lit(w)).cast("long")
    rest = us - q * w
    up = (rest * 2 > w) | ((rest * 2 == w) & (q % 2 != 0))
    return from_micros((q + F.when(up, 1).otherwise(0)) * w)


def round_keep_last(df: DataFrame, frequency: str | int, *ties: str) -> DataFrame:
    """ts rounded; of rows that meet, the last by ts (then by ties) stays."""
    names = [c for c in df.columns if c not in (SERIES, "ts")]
    last = F.max_by(F.struct(*names), F.struct("ts", *ties)).alias("__row")
    return df.groupBy(SERIES, rounded(F.col("ts"), frequency).alias("__ts")).agg(last).select(SERIES, F.col("__ts").alias("ts"), "__row.*")


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """start <= ts < end. For bars: after resampling, since bins begin at the first row."""
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return df


#: Of percentile_approx: ranks are off by at most one in so many rows.
ACCURACY = 10_000


def percentiles(df: DataFrame, column: str, shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(series_id, q): the exact, interpolated percentiles of column at the shares; nulls don't count.

    Sketches bound each percentile from both sides; rows below are only counted, and the few between the
    bounds are put in order. A series of fewer rows than accuracy is ordered whole."""
    slack = 4 / accuracy
    v = df.select(SERIES, F.col(column).cast("double").alias("__x")).where("__x is not null")
    edges = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-slack, slack)]
    near = v.groupBy(SERIES).agg(F.percentile_approx("__x", edges, accuracy).alias("__e"), F.count("__x").alias("__n"))
    edge = lambda i, inside: F.when(F.lit(inside) & (F.col("__n") >= accuracy), F.col("__e")[i])
    spans = [
        F.struct(F.lit(float(p)).alias("p"), edge(2 * i, p > slack).alias("low"), edge(2 * i + 1, p + slack < 1).alias("high"))
        for i, p in enumerate(shares)
    ]
    near = near.select(SERIES, "__n", F.posexplode(F.array(*spans)).alias("__i", "__s"))
    key = F.when(F.col("__s.low").isNull() | (F.col("__x") >= F.col("__s.low")), F.col("__x")).alias("__k")
    rows = v.join(near, SERIES).where(F.col("__s.high").isNull() | (F.col("__x") <= F.col("__s.high")))
    place = (F.col("__s.p") * (F.col("__n") - 1)).alias("__p")
    counts = rows.groupBy(SERIES, "__i", place, key).agg(F.count(F.lit(1)).alias("__m"))
    upto = Window.partitionBy(SERIES, "__i").orderBy(F.asc_nulls_first("__k")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__c", F.sum("__m").over(upto))
    at = lambda rank: F.min(F.when(F.col("__c") > rank, F.col("__k")))
    found = counts.groupBy(SERIES, "__i", "__p").agg(at(F.floor("__p")).alias("__a"), at(F.ceil("__p")).alias("__b"))
    between = (F.ceil("__p") - F.col("__p")) * F.col("__a") + (F.col("__p") - F.floor("__p")) * F.col("__b")
    q = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(between)
    pairs = F.array_sort(F.collect_list(F.struct("__i", q.alias("q"))))
    return found.groupBy(SERIES).agg(pairs.alias("__q")).select(SERIES, F.col("__q.q").alias("q"))


def winsorize(df: DataFrame, column: str, low: float = 15.0, high: float | None = None) -> DataFrame:
    """column clipped, per series, to 1.5 ranges beyond its low and high percentile (exact, interpolated)."""
    high = 100 - low if high is None else high
    q = percentiles(df, column, [low / 100, high / 100]).withColumnRenamed("q", "__q")
    spread = (F.col("__q")[1] - F.col("__q")[0]) * 1.5
    clipped = F.least(F.greatest(F.col(column), F.col("__q")[0] - spread), F.col("__q")[1] + spread)
    return df.join(q, SERIES, "left").withColumn(column, F.when(F.col(column).isNotNull(), clipped)).drop("__q")


def true_range(df: DataFrame) -> DataFrame:
    """df (with pos) with true_range: the widest of this bar's range and the moves from the last close; null at first."""
    last = lambda w: F.lag("close").over(w)
    widest = lambda w: F.when(last(w).isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last(w)), F.abs(F.col("low") - last(w))))
    return framed(df, {"true_range": widest}, before=1)


def volume_proxy(df: DataFrame) -> DataFrame:
    """Volume replaced by the true range in series whose most frequent volume (the least, of several) is 0."""
    each = df.where("volume is not null").groupBy(SERIES, "volume").agg(F.count(F.lit(1)).alias("__n"))
    usual = each.groupBy(SERIES).agg(F.min_by("volume", F.struct(-F.col("__n"), "volume")).alias("__usual"))
    out = true_range(df).join(usual, SERIES, "left")
    return out.withColumn("volume", F.when(F.col("__usual") == 0, F.col("true_range")).otherwise(F.col("volume"))).drop("__usual", "true_range")


def require_finite(df: DataFrame, *columns: str) -> DataFrame:
    """df, if every value of the columns is a finite number; else DataError. Reads df once."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    n = df.agg(F.count_if(bad)).first()[0]
    if n:
        raise DataError(f"{n} rows have values that are missing or not finite in {', '.join(columns)}")
    return df


def scaling(df: DataFrame, column: str, domain: str = "asinh") -> DataFrame:
    """(series_id, low, high) of asinh(column), or of the raw column: what asinh_scale divides by."""
    v = F.asinh(column) if domain == "asinh" else F.col(column)
    return df.groupBy(SERIES).agg(F.min(v).alias("low"), F.max(v).alias("high"))


def asinh_scale(df: DataFrame, column: str, params: DataFrame | None = None, domain: str = "asinh", out: str = "scaled") -> DataFrame:
    """(asinh(x) - low) / (high - low) by series, 0 where high is low; params from another table, or df's own."""
    p = scaling(df, column, domain) if params is None else params
    p = p.select(SERIES, F.col("low").alias("__low"), F.col("high").alias("__high"))
    width = F.col("__high") - F.col("__low")
    value = F.when(width == 0, 0.0).otherwise((F.asinh(column) - F.col("__low")) / width)
    return df.join(p, SERIES).withColumn(out, value).drop("__low", "__high")


def prepare(
    df: DataFrame, current: str = "1min", target: str = "1h", start: str | None = None, end: str | None = None, zone: str = "UTC",
    buffer: int = 0, outliers: bool = True, legacy: bool = False,
) -> DataFrame:
    """The loader's chain on raw bars: clean, shift to UTC, volume, round, resample, round, range, returns.

    legacy leaves out the shift and both roundings."""
    from tidelode.operators.bars import forward_returns, resample

    df = drop_incomplete(df)
    if not legacy and zone != "UTC":
        df = convert_zone(df, zone, "UTC")
    df = volume_proxy(number_rows(df)).drop("pos")
    if not legacy:
        df = round_keep_last(df, current)
    if seconds(target) > seconds(current):
        df = resample(df, current, target, buffer)
    if not legacy:
        df = round_keep_last(df, target)
    df = forward_returns(number_rows(date_range(df, start, end)))
    return winsorize(df, "returns", 0.0001) if outliers else df


def check_labels(df: DataFrame, clusters: int, label: str = "label", value: str = "returns") -> DataFrame:
    """Sizes by cluster, after checks: labels below clusters, values finite. Small clusters are the caller's to judge."""
    worst = df.agg(F.max(label), F.min(label)).first()
    if worst[0] is not None and (worst[0] >= clusters or worst[1] < -1):
        raise DataError(f"labels must be below {clusters}")
    require_finite(df, value)
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
