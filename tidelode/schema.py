"""Types, frequencies and errors that all modules share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
PRICES = ("open", "high", "low", "close")
REQUIRED = ("time", *PRICES, "volume")
MOVEMENT = ("vertical", "horizontal", "angle", "speed", "acceleration", "magnitude", "volatility", "trend")
EPS = 1e-10
YEAR = 252
_UNITS = {"s": 1, "sec": 1, "min": 60, "t": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800}


class DataError(ValueError):
    """The data isn't what an operator needs."""


def seconds(frequency: str | int) -> int:
    """'5min', '1h', '1D' or a number of seconds, in seconds."""
    if isinstance(frequency, int):
        return frequency
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", frequency)
    unit = m and (_UNITS.get(m[2].lower()) or _UNITS.get(m[2].lower().rstrip("s")))
    if not unit:
        raise DataError(f"not a frequency: {frequency!r}")
    return int(m[1] or 1) * unit


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone (or of one, in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def need_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise DataError(f"missing columns: {', '.join(missing)}")
    return df


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once for a row, even where f uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def array_mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def array_std(v: Column) -> Column:
    """Population standard deviation of an array's values."""
    return let(array_mean(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)))
