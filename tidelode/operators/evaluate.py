"""Evaluation of clusters by what follows their members.

One aggregation serves all clusters and both directions; a label at position t trades the return from
t to t + 1. Only a row for each cluster and direction reaches the driver, where t intervals are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelode.functions import metrics, student
from tidelode.operators import cleaning, hold, reducers
from tidelode.operators.ordered import SERIES, framed
from tidelode.operators.scorer import MovementScorer, price_change
from tidelode.schema import DataError, array_std
from tidelode.sources.scratch import stored

KEYS = (SERIES, "cluster")
#: Evaluators of one's own: name to a function of (labels, scaled, returns, params) that returns the chosen clusters as
#: (cluster, side, score, ...), side 1 or -1.
CUSTOM: dict[str, Callable[[DataFrame, DataFrame, DataFrame, dict], DataFrame]] = {}


def register(name: str, choose: Callable[[DataFrame, DataFrame, DataFrame, dict], DataFrame]) -> None:
    CUSTOM[name] = choose


def cluster_returns(labels: DataFrame, returns: DataFrame, period: int) -> DataFrame:
    """(series_id, cluster, pos, returns) of the positions that clusters hold; labels: (series_id, pos, cluster)."""
    positions = hold.held(labels.select(*KEYS, "pos"), period, KEYS).select(*KEYS, "pos")
    return positions.join(returns.select(SERIES, "pos", "returns"), [SERIES, "pos"])


def holding_metrics(labels: DataFrame, returns: DataFrame, period: int, min_samples: int = 50, by: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """A row for each cluster with enough members and each direction: metrics of its held returns, negated when short."""
    members = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= min_samples)
    r = stored(cluster_returns(labels, returns, period), "held")  # it is read four times
    both = r.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("returns", F.col("returns") * F.col("side"))
    keys = (*by, "side")
    ordered = _pooled(both, keys)
    aggs = metrics.simple(F.col("returns")) | metrics.ordered() | {"std": F.stddev_pop("returns"), "skew": F.skewness("returns"), "kurtosis": F.kurtosis("returns"), "sem": F.stddev_samp("returns") / F.sqrt(F.count("returns"))}
    out = metrics.with_drawdowns(ordered, keys, pos="__p").groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.join(members, list(by))


def _pooled(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """df with __p, its place among the rows of its keys: series follow one another."""
    c = df.withColumn("__c", F.expr("pos div 65536"))
    counts = c.groupBy(*keys, SERIES, "__c").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(SERIES, "__c").rowsBetween(Window.unboundedPreceding, -1)
    names = list(dict.fromkeys([*keys, SERIES, "__c"]))
    counts = counts.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*names, "__o")
    inner = Window.partitionBy(*names).orderBy("pos")
    return c.withColumn("__r", F.row_number().over(inner) - 1).join(counts, names).withColumn("__p", F.col("__o") + F.col("__r")).drop("__c", "__r", "__o")


def better_side(both: DataFrame, by: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """The direction with the larger martin ratio for each cluster; short if they are equal or unknown."""
    lead = F.struct(F.coalesce(F.col("martin"), F.lit(-math.inf)).alias("m"), (-F.col("side")).alias("s"))
    names = [c for c in both.columns if c not in by]
    return both.groupBy(*by).agg(F.max_by(F.struct(*names), lead).alias("__b")).select(*by, "__b.*")


def selection_score() -> Column:
    """What ranks clusters: martin, Sharpe, profit factor and win rate by weight; what is unknown counts 0."""
    parts = (("martin", 0.4), ("sharpe", 0.3), ("profit_factor", 0.2), ("win_rate", 0.1))
    return sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))


def select_clusters(best: DataFrame, baseline: float = 0.0) -> DataFrame:
    """best with score: the clusters worth trading, by direction, whose |score| exceeds the baseline, best first."""
    s = best.withColumn("score", selection_score())
    return s.where((F.abs("score") > baseline) & (F.col("martin") > 0) & (F.col("avg_return") > 0)).orderBy(F.desc("score"), "cluster")


def with_interval(stats: list[dict], confidence: float = 0.95) -> list[dict]:
    """Rows with n, avg (or mean) and sem extended by a t interval and the p of a mean of 0."""
    out = []
    for r in stats:
        n, sem = r["n"], r.get("sem")
        mean = r["mean"] if "mean" in r else r["annual_return"] / metrics.YEAR
        ok = n > 1 and sem is not None and sem > 0
        low, high = student.interval(mean, sem, n, confidence) if ok else (None, None)
        p = student.two_sided(mean / sem, n - 1) if ok else None
        out.append(r | {"lower": low, "upper": high, "p_value": p})
    return out


def with_t_interval(stats: DataFrame, mean: str = "mean", sem: str = "sem", n: str = "n", confidence: float = 0.95) -> DataFrame:
    """stats with lower, upper and p_value: the t interval of the mean and the p of a mean of 0; null without a deviation."""
    ok = (F.col(n) > 1) & (F.col(sem) > 0)
    free = F.when(ok, F.col(n) - 1)
    half = student.quantile_column(0.5 + confidence / 2, free) * F.col(sem)
    p = student.two_sided_column(F.when(ok, F.col(mean) / F.col(sem)), free)
    return stats.withColumn("__h", half).withColumns({"lower": F.col(mean) - F.col("__h"), "upper": F.col(mean) + F.col("__h"), "p_value": p}).drop("__h")


def significant_patterns(stats: DataFrame, p_limit: float = 0.05, least_consistency: float = 0.6) -> DataFrame:
    """Of performances with p values, those that are significant and consistent, with score and side."""
    kept = stats.where((F.col("p_value") < p_limit) & (F.col("consistency") >= least_consistency))
    return kept.withColumns({"score": F.abs("mean") * (1 - F.col("std")) * F.col("consistency"), "side": F.when(F.col("mean") > 0, 1).otherwise(-1)})


def cluster_signal(cluster: Column, long: list[int], short: list[int]) -> Column:
    """1 for long clusters, -1 for short ones, else 0."""
    return F.when(cluster.isin(long), 1).when(cluster.isin(short), -1).otherwise(0) if long or short else F.lit(0)


def strategy_returns(labels: DataFrame, returns: DataFrame, long: list[int], short: list[int]) -> DataFrame:
    """(series_id, pos, signal, returns): each label's signal times the return at its position."""
    joined = labels.join(returns.select(SERIES, "pos", "returns"), [SERIES, "pos"])
    side = cluster_signal(F.col("cluster"), long, short)
    return joined.select(SERIES, "pos", side.alias("signal"), (F.col("returns") * side).alias("returns"))


def strategy_performance(labels: DataFrame, returns: DataFrame, long: list[int], short: list[int]) -> DataFrame:
    """All metrics of the strategy by series."""
    return metrics.performance(strategy_returns(labels, returns, long, short), [SERIES])


def transitions(labels: DataFrame, label: str = "cluster") -> DataFrame:
    """(from, to, n, p): how often a label follows another in a series; rows add up to 1. Null and -1 are no labels."""
    known = labels.where(F.col(label).isNotNull() & (F.col(label) != -1))
    # the next known label may be any number of positions on: pair each with it by a running last value
    pairs = _next_known(known, label).groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("from").agg(F.sum("n").alias("__t"))
    return pairs.join(totals, "from").select("from", "to", "n", (F.col("n") / F.col("__t")).alias("p"))


def _next_known(known: DataFrame, label: str, chunk: int = 1 << 16) -> DataFrame:
    c = known.select(SERIES, "pos", F.col(label).alias("from"), F.expr(f"pos div {chunk}").alias("__c"))
    firsts = c.groupBy(SERIES, "__c").agg(F.min_by("from", "pos").alias("__f"))
    later = Window.partitionBy(SERIES).orderBy("__c")
    firsts = firsts.select(SERIES, "__c", F.lead("__f").over(later).alias("__f"))
    inner = Window.partitionBy(SERIES, "__c").orderBy("pos")
    c = c.withColumn("to", F.lead("from").over(inner)).join(firsts, [SERIES, "__c"])
    return c.select("from", F.coalesce("to", "__f").alias("to")).where("to is not null")


def signal_distribution(df: DataFrame, by: str = "cluster", signal: str = "signal") -> DataFrame:
    """Shares of long, flat and short signals, and how many there are."""
    share = lambda s: F.avg((F.col(signal) == s).cast("double"))
    return df.groupBy(by).agg(share(1).alias("long_share"), share(0).alias("flat_share"), share(-1).alias("short_share"), F.count(F.lit(1)).alias("n"))


def cluster_pattern(df: DataFrame, column: str = "features", by: str = "cluster") -> DataFrame:
    """(cluster, i, mean, std): each coordinate's mean and population deviation."""
    return df.select(by, F.posexplode(column).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def histogram(df: DataFrame, value: str, bins: int, by: tuple[str, ...] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """(by, bin, n, density) over equal bins from the least to the largest value of each group, or from low to high.

    The last bin has its right edge; a group of one value has it in the first bin, one wide."""
    if low is None:
        edges = df.groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
        d = df.join(edges, list(by)) if by else df.join(F.broadcast(edges))
    else:
        d = df.withColumns({"__low": F.lit(float(low)), "__high": F.lit(float(high))}).where((F.col(value) >= low) & (F.col(value) <= high))
    width = (F.col("__high") - F.col("__low")) / bins
    at = F.when(F.col("__high") == F.col("__low"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("__low")) / F.nullif(width, F.lit(0.0))).cast("int"), F.lit(bins - 1)))
    counts = d.withColumn("bin", at).groupBy(*by, "bin", "__low", "__high").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__t"))
    c = counts.join(totals, list(by)) if by else counts.join(F.broadcast(totals))
    w = F.when(F.col("__high") == F.col("__low"), 1.0).otherwise((F.col("__high") - F.col("__low")) / bins)
    return c.select(*by, "bin", "n", (F.col("n") / (F.col("__t") * w)).alias("density"))


def window_pairs(labels: DataFrame, values: DataFrame, n_future: int, min_movement: float = 0.001, max_noise: float = 0.1) -> DataFrame:
    """(series_id, cluster, pos, current, future): the 2F values from each member on and the 2F after them.

    Only pairs of enough range and little noise; of a cluster's overlapping pairs the earliest."""
    f = 2 * n_future
    spans = framed(values.select(SERIES, "pos", "value"), {"__w": lambda w: F.collect_list("value").over(w.rowsBetween(0, 2 * f - 1))}, after=2 * f - 1)
    spans = spans.where(F.size("__w") == 2 * f).select(SERIES, "pos", F.slice("__w", 1, f).alias("current"), F.slice("__w", f + 1, f).alias("future"))
    pairs = labels.select(*KEYS, "pos").join(spans, [SERIES, "pos"]).where(pair_quality(F.col("current"), F.col("future"), min_movement, max_noise))
    return pairs.join(hold.accept(pairs, 2 * f - 1, KEYS), [*KEYS, "pos"])


def require_apart(pairs: DataFrame, span: int, by: tuple[str, ...] = KEYS) -> DataFrame:
    """pairs, if those of the same keys lie more than span positions apart; else DataError. Reads pairs twice."""
    n, apart = pairs.select(*by, "pos").distinct().count(), hold.accept(pairs, span, by).count()
    if n != apart:
        raise DataError(f"{n - apart} pairs overlap one before them")
    return pairs


def pair_quality(current: Column, future: Column, min_movement: float = 0.001, max_noise: float = 0.1) -> Column:
    """Both ranges reach their mean times min_movement; steps deviate by at most max_noise of it."""
    span = lambda v: F.array_max(v) - F.array_min(v)
    mean = (span(current) + span(future)) / 2
    steps = lambda v: F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda a, b: a - b)
    calm = lambda v: array_std(steps(v)) <= mean * max_noise
    return (mean > 0) & (span(current) >= mean * min_movement) & (span(future) >= mean * min_movement) & calm(current) & calm(future)


def pattern_samples(pairs: DataFrame, n_future: int) -> DataFrame:
    """pairs with future vectors, features (the last movement of the current window) and change."""
    d = pairs.withColumns(
        {"vectors": reducers.movement_features(F.col("current"), n_future + 1), "future_vectors": reducers.movement_features(F.col("future"), n_future + 1)}
    ).where((F.size("vectors") > 0) & (F.size("future_vectors") > 0))
    return d.select(*KEYS, "pos", F.element_at("vectors", -1).alias("features"), F.col("future_vectors").alias("future"), price_change(F.col("future_vectors")).alias("change"))


def pattern_performance(samples: DataFrame, scorer: MovementScorer) -> DataFrame:
    """A row for each cluster: moments of the scores of its members' futures, consistency of their signs, sem and n.

    Medians come from bounds and counts, not from a cluster's values in one place."""
    s = samples.withColumn("score", scorer.score_sequence(F.col("future"))).select("cluster", "score")
    sign = F.greatest(F.avg((F.col("score") > 0).cast("double")), F.avg((F.col("score") < 0).cast("double")))
    aggs = metrics.moments(F.col("score")) | {"consistency": sign, "sem": F.stddev_samp("score") / F.sqrt(F.count("score")), "n": F.count("score")}
    rows = s.groupBy("cluster").agg(*[c.alias(n) for n, c in aggs.items() if n != "median"])
    middle = cleaning.percentiles(s.withColumnRenamed("cluster", SERIES), "score", [0.5]).select(F.col(SERIES).alias("cluster"), F.col("q")[0].alias("median"))
    return rows.join(middle, "cluster", "left").select("cluster", *aggs)


def select_patterns(stats: list[dict], p_limit: float = 0.05, least_consistency: float = 0.6) -> list[dict]:
    """Of performances with p values: those that are significant and consistent, with score and side, best first."""
    out = []
    for r in stats:
        if r["p_value"] is not None and r["p_value"] < p_limit and r["consistency"] >= least_consistency:
            out.append(r | {"score": abs(r["mean"]) * (1 - r["std"]) * r["consistency"], "side": 1 if r["mean"] > 0 else -1})
    return sorted(out, key=lambda r: (-r["score"], r["cluster"]))

