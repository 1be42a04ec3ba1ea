"""Performance metrics of returns as aggregates over groups.

Simple ones are aggregate expressions; those that need the order (compounded drawdowns) come from
``performance``, which adds the equity curve by running totals of logarithms. Returns at or below -1
end an equity curve; its logarithm is cut at a tiny number. 0 / 0 is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelode.schema import YEAR

_ROOT = YEAR**0.5


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def sharpe(r: Column) -> Column:
    return ratio(F.avg(r), F.stddev_samp(r)) * _ROOT


def sortino(r: Column) -> Column:
    downside = F.sqrt(F.sum(F.when(r < 0, r * r).otherwise(0.0)) / F.count(r))
    return ratio(F.avg(r), downside) * _ROOT


def profit_factor(r: Column) -> Column:
    return F.abs(ratio(F.sum(F.when(r >= 0, r).otherwise(0.0)), F.sum(F.when(r < 0, r).otherwise(0.0))))


def win_rate(r: Column) -> Column:
    return ratio(F.count_if(r > 0).cast("double"), F.count_if(r != 0).cast("double"))


def avg_return(r: Column) -> Column:
    return F.avg(F.when(r != 0, r))


def avg_win(r: Column) -> Column:
    return F.avg(F.when(r > 0, r))


def avg_loss(r: Column) -> Column:
    return F.avg(F.when(r < 0, r))


def risk_of_ruin(r: Column) -> Column:
    w = win_rate(r)
    return F.pow((1 - w) / (1 + w), F.count(r).cast("double"))


def information_ratio(r: Column, benchmark: Column) -> Column:
    """Mean active return by its population deviation, by the year."""
    return ratio(F.avg(r - benchmark), F.stddev_pop(r - benchmark)) * _ROOT


def moments(x: Column) -> dict[str, Column]:
    """Mean, median and population deviation, skewness, excess kurtosis."""
    return {"mean": F.avg(x), "median": F.percentile(x, F.lit(0.5)), "std": F.stddev_pop(x), "skew": F.skewness(x), "kurtosis": F.kurtosis(x)}


def simple(r: Column) -> dict[str, Column]:
    return {
        "total_return": F.sum(r),
        "annual_return": F.avg(r) * YEAR,
        "volatility": F.stddev_pop(r) * _ROOT,
        "sharpe": sharpe(r),
        "sortino": sortino(r),
        "profit_factor": profit_factor(r),
        "win_rate": win_rate(r),
        "avg_return": avg_return(r),
        "avg_win": avg_win(r),
        "avg_loss": avg_loss(r),
        "risk_of_ruin": risk_of_ruin(r),
        "n": F.count(r),
    }


def with_drawdowns(df: DataFrame, by: Sequence[str], value: str = "returns", pos: str = "pos", chunk: int = 1 << 16) -> DataFrame:
    """df with __equity (compounded, from 1) and __dd (equity over its maximum so far, 1 included, less 1).

    Running values go by chunks of positions, so that no group is in one task."""
    log = F.log(F.greatest(1 + F.col(value), F.lit(1e-300)))
    c = df.withColumns({"__c": F.expr(f"{pos} div {chunk}"), "__l": log})
    inner = Window.partitionBy(*by, "__c").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("__s", F.sum("__l").over(inner))
    c = c.withColumn("__m", F.max("__s").over(inner))
    totals = c.groupBy(*by, "__c").agg(F.sum("__l").alias("__t"), F.max("__s").alias("__p"))
    earlier = Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__o", F.coalesce(F.sum("__t").over(earlier), F.lit(0.0)))
    totals = totals.withColumn("__q", F.coalesce(F.max(F.col("__o") + F.col("__p")).over(earlier), F.lit(0.0)))
    t = totals.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)], F.col("__c").alias("__kc"), "__o", "__q")
    on = F.col("__c") == F.col("__kc")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__k{i}"))
    c = c.join(t, on)
    now = F.col("__o") + F.col("__s")
    peak = F.greatest(F.lit(0.0), F.col("__q"), F.col("__o") + F.col("__m"))
    return c.withColumns({"__equity": F.exp(now), "__dd": F.exp(now - peak) - 1}).drop("__c", "__l", "__s", "__m", "__o", "__q", "__kc", *[f"__k{i}" for i in range(len(by))])


def ordered(dd: str = "__dd", value: str = "returns") -> dict[str, Column]:
    """Metrics over rows that with_drawdowns has extended."""
    d = F.col(dd)
    compounded = F.exp(F.sum(F.log(F.greatest(1 + F.col(value), F.lit(1e-300))))) - 1
    ulcer = F.sqrt(F.sum(d * d) / F.nullif(F.count(d) - 1, F.lit(0)))
    return {"compounded": compounded, "ulcer": ulcer, "martin": ratio(compounded, ulcer), "max_drawdown": F.min(d), "mean_drawdown": F.avg(d)}


def performance(df: DataFrame, by: Sequence[str], value: str = "returns") -> DataFrame:
    """All metrics of each group of rows (by, pos, value)."""
    aggs = simple(F.col(value)) | ordered(value=value)
    return with_drawdowns(df, by, value).groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def chart_metrics(df: DataFrame, by: Sequence[str], value: str = "returns") -> DataFrame:
    """Sharpe with the population deviation, annual return, and the largest additive drawdown (of dd)."""
    r = F.col(value)
    return df.groupBy(*by).agg((ratio(F.avg(r), F.stddev_pop(r)) * _ROOT).alias("sharpe"), (F.avg(r) * YEAR).alias("annual_return"), F.min("drawdown").alias("max_drawdown"))
