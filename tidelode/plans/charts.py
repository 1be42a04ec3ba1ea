"""The data behind every chart of the pipeline; drawing is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelode.operators import evaluate, windows
from tidelode.operators.ordered import SERIES
from tidelode.schema import YEAR

SHOWN = ("martin", "sharpe", "profit_factor", "win_rate", "avg_return", "max_drawdown")


def clusters(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(series_id, pos, value, cluster): the series with its labels; -1 where there is none."""
    return values.select(SERIES, "pos", "value").join(labels.select(SERIES, "pos", "cluster"), [SERIES, "pos"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def equity(returns: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """(series_id, pos, equity[, benchmark]): running sums of returns."""
    out = windows.cumulative(returns).select(SERIES, "pos", "equity")
    if benchmark is None:
        return out
    return out.join(windows.cumulative(benchmark, out="benchmark").select(SERIES, "pos", "benchmark"), [SERIES, "pos"])


def cluster_performance(stats: DataFrame, names: tuple[str, ...] = SHOWN) -> DataFrame:
    """(cluster, side, metric, value): a bar each."""
    return stats.unpivot(["cluster", "side"], [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def dashboard(returns: DataFrame, signals: DataFrame, window: int = YEAR, bins: int = 50) -> dict[str, DataFrame]:
    """The six panels: equity, rolling Sharpe, histogram, counts of signals, drawdown, rolling volatility."""
    rolled = windows.rolling(returns, window=window)
    return {
        "equity": equity(returns),
        "rolling_sharpe": rolled.select(SERIES, "pos", "rolling_sharpe"),
        "returns": evaluate.histogram(returns, "returns", bins, (SERIES,)),
        "signals": signals.groupBy("signal").agg(F.count(F.lit(1)).alias("n")),
        "drawdown": windows.drawdown(returns).select(SERIES, "pos", "drawdown"),
        "rolling_vol": rolled.select(SERIES, "pos", "rolling_vol"),
    }


def safe_name(title: str) -> str:
    """A file name of a title: lower case, blanks as underscores, nothing but letters, digits, _ and -."""
    return "".join(c for c in title.lower().replace(" ", "_") if c.isalnum() or c in "_-")
