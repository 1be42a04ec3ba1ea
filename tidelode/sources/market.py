"""Reading markets: one parquet file or folder for each symbol under a few subfolders, CSV, in-memory prices."""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.operators.cleaning import parse_time, prepare
from tidelode.operators.ordered import SERIES
from tidelode.schema import REQUIRED, DataError, need_columns

# The subfolders of a market folder, in the order in which they are looked through.
SUBFOLDERS = ("daily", "crypto", "forex", "futures", "misc", "MT5")
LEGACY_SUBFOLDERS = SUBFOLDERS[:-1]


def read_env(path: str = ".env") -> dict[str, str]:
    """NAME=value lines of a file, if it is there; names that the environment lacks are set in it."""
    found = {}
    if os.path.isfile(path):
        with open(path) as f:
            for line in f:
                name, sep, value = line.strip().partition("=")
                if sep and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("'\"")
                    os.environ.setdefault(name.strip(), found[name.strip()])
    return found


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, symbol: str, root: str | None = None, subpath: str | None = None, legacy: bool = False) -> str:
    """The first {root}/{subfolder}/{SYMBOL}.parquet there is; root is DATA_PATH of the environment unless given."""
    root = root or os.environ.get("DATA_PATH")
    if not root:
        raise DataError("no market folder: DATA_PATH is not set")
    if not exists(spark, root):
        raise FileNotFoundError(root)
    for sub in [subpath] if subpath else LEGACY_SUBFOLDERS if legacy else SUBFOLDERS:
        path = f"{root}/{sub}/{symbol.upper()}.parquet"
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"{symbol.upper()}.parquet under {root}")


def find(spark: SparkSession, symbols: Iterable[str], root: str | None = None, subpath: str | None = None, legacy: bool = False) -> dict[str, str]:
    """Each symbol's path, as resolve() finds it; a listing of each subfolder, whatever the number of symbols."""
    wanted = list(dict.fromkeys(s.upper() for s in symbols))
    root = root or os.environ.get("DATA_PATH")
    if not root:
        raise DataError("no market folder: DATA_PATH is not set")
    if not exists(spark, root):
        raise FileNotFoundError(root)
    found: dict[str, str] = {}
    names = {f"{s}.parquet": s for s in wanted}
    for sub in [subpath] if subpath else LEGACY_SUBFOLDERS if legacy else SUBFOLDERS:
        if len(found) == len(wanted):
            break
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{sub}")
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for name in [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []:
            if name in names:
                found.setdefault(names[name], f"{root}/{sub}/{name}")
    if missing := [s for s in wanted if s not in found]:
        raise FileNotFoundError(f"{', '.join(f'{s}.parquet' for s in missing)} under {root}")
    return {s: found[s] for s in wanted}


def _checked(df: DataFrame, series: Column) -> DataFrame:
    df = parse_time(need_columns(df, *REQUIRED).select(*REQUIRED, series.alias(SERIES)))
    return df.select(SERIES, "ts", *[F.col(c).cast("double") for c in REQUIRED[1:]])


def to_raw(df: DataFrame, series: str) -> DataFrame:
    """The required columns, checked, as (series_id, ts, open, high, low, close, volume)."""
    return _checked(df, F.lit(series))


def read_raw(spark: SparkSession, symbols: str | Iterable[str], **where) -> DataFrame:
    """Raw bars of one symbol or several.

    Several are one scan of the asked symbols' files, with the symbol taken from the file's path. Files whose columns
    don't go together in one schema are read by themselves."""
    if isinstance(symbols, str):
        return to_raw(spark.read.parquet(resolve(spark, symbols, **where)), symbols.upper())
    found = find(spark, symbols, **where)
    try:
        df = spark.read.option("mergeSchema", True).parquet(*found.values())
    except Exception as e:  # of differing types Spark says so when it merges
        if "MERGE_SCHEMAS" not in str(e) and "merge" not in str(e):
            raise
        frames = [to_raw(spark.read.parquet(path), symbol) for symbol, path in found.items()]
        return reduce(DataFrame.unionByName, frames)
    # + stands for itself in paths, but not for url_decode
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return _checked(df, F.regexp_extract(path, r"([^/]+)\.parquet(?:/[^/]*)?$", 1))


def load(spark: SparkSession, symbol: str | Iterable[str], target: str, start: str | None = None, end: str | None = None, root: str | None = None, subpath: str | None = None, legacy: bool = False, **cleaning) -> DataFrame:
    """Bars of the target frequency with forward returns."""
    return prepare(read_raw(spark, symbol, root=root, subpath=subpath, legacy=legacy), target=target, start=start, end=end, legacy=legacy, **cleaning)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def from_prices(spark: SparkSession, prices: Iterable[float], series: str = "series") -> DataFrame:
    """(series_id, pos, value) of prices in memory; they must be finite numbers."""
    rows = [(series, i, float(p)) for i, p in enumerate(prices)]
    if any(p != p or abs(p) == float("inf") for _, _, p in rows):
        raise DataError("prices must be finite")
    return spark.createDataFrame(rows, "series_id string, pos long, value double")
