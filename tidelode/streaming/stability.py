"""Stability of clusterings over batches: batches are rows (batch, cluster, features, ...), in any number.

All detectors are aggregates by batch followed by a window over batches, of which there are few rows;
the recursive ones have closed forms: a posterior that becomes the next prior is a running product of
likelihoods, a one-sided cumulative sum is a running sum less its running minimum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidelode.operators.distance import l2
from tidelode.schema import EPS, array_mean


def _in_order() -> WindowSpec:
    """All batches in order: a row each, so one task has few."""
    return Window.partitionBy(F.lit(0)).orderBy("batch")



def label_stability(df: DataFrame, k: int) -> DataFrame:
    """(batch, stability): 1 less the mean change of the k label shares since the batch before; 1 at first."""
    n = df.groupBy("batch").pivot("cluster", list(range(k))).count().na.fill(0)
    total = sum((F.col(str(i)) for i in range(k)), F.lit(0))
    share = lambda i: F.col(str(i)) / total
    change = sum((F.abs(share(i) - F.lag(share(i)).over(_in_order())) for i in range(k)), F.lit(0.0)) / k
    return n.select("batch", F.coalesce(1 - change, F.lit(1.0)).alias("stability"))


def radii(df: DataFrame, column: str = "features") -> DataFrame:
    """(batch, cluster, n, radius): mean distance of a cluster's rows to their mean."""
    each = df.select("batch", "cluster", F.posexplode(column).alias("i", "x")).groupBy("batch", "cluster", "i").agg(F.avg("x").alias("x"))
    center = each.groupBy("batch", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("__c"))
    d = df.join(center, ["batch", "cluster"]).withColumn("__d", l2(F.col(column), F.col("__c")))
    return d.groupBy("batch", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("radius"))


def density_stability(df: DataFrame, column: str = "features") -> DataFrame:
    """(batch, density, stability): density is the mean of 1 / radius over clusters of two rows or more."""
    d = radii(df, column).groupBy("batch").agg(F.coalesce(F.avg(F.when(F.col("n") >= 2, 1 / (F.col("radius") + EPS))), F.lit(0.0)).alias("density"))
    return d.withColumn("stability", F.coalesce(1 - F.abs(F.col("density") - F.lag("density").over(_in_order())), F.lit(1.0)))


def bayes_stability(df: DataFrame, k: int, column: str = "features") -> DataFrame:
    """(batch, stability): 1 less the mean change of the clusters' posterior, which is the next batch's prior.

    A cluster's likelihood is the standard normal density at its radius, and EPS where it is empty."""
    r = radii(df, column)
    grid = r.select("batch").distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lik = F.exp(-F.col("radius") * F.col("radius") / 2) / math.sqrt(2 * math.pi)
    g = grid.join(r, ["batch", "cluster"], "left").withColumn("__l", F.log(F.coalesce(lik, F.lit(0.0)) + EPS))
    own = Window.partitionBy("cluster").orderBy("batch")
    g = g.withColumn("__s", F.sum("__l").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    batch = Window.partitionBy("batch")
    e = F.exp(F.col("__s") - F.max("__s").over(batch))
    g = g.withColumn("__p", e / F.sum(e).over(batch))
    g = g.withColumn("__c", F.abs(F.col("__p") - F.coalesce(F.lag("__p").over(own), F.lit(1.0 / k))))
    return g.groupBy("batch").agg((1 - F.avg("__c")).alias("stability"))


def cusum(df: DataFrame, threshold: float = 2.0, history: int = 1000, column: str = "features") -> DataFrame:
    """(batch, change): the larger one-sided cumulative sum of the batch means' deviations over the threshold, at most 1.

    A deviation is the z-score among the means of the batches before; the first two batches have none."""
    m = df.select("batch", array_mean(F.col(column)).alias("__x")).groupBy("batch").agg(F.avg("__x").alias("mean"))
    past = _in_order().rowsBetween(-history, -1)
    so_far = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    sd = F.stddev_pop("mean").over(past)
    z = (F.col("mean") - F.avg("mean").over(past)) / F.when(sd == 0, EPS).otherwise(sd)
    m = m.withColumn("__i", F.row_number().over(_in_order())).withColumn("__z", F.when(F.col("__i") > 2, z).otherwise(0.0))
    m = m.withColumns({"__a": F.sum("__z").over(so_far), "__b": F.sum(-F.col("__z")).over(so_far)})
    above = lambda c: F.col(c) - F.least(F.min(c).over(so_far), F.lit(0.0))
    return m.select("batch", F.least(F.greatest(above("__a"), above("__b")) / threshold, F.lit(1.0)).alias("change"))


def histogram_drift(df: DataFrame, value: str = "value", bins: int = 20) -> DataFrame:
    """(batch, stability): 1 less the root Jensen-Shannon divergence from the batch before; 1 for the first two.

    Bins are those of the first batch, its ends open."""
    first = df.agg(F.min("batch").alias("__f"))
    edges = df.join(F.broadcast(first)).where("batch = __f").agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    width = F.nullif((F.col("__high") - F.col("__low")) / bins, F.lit(0.0))
    at = F.coalesce(F.greatest(F.least(F.floor((F.col(value) - F.col("__low")) / width).cast("int"), F.lit(bins - 1)), F.lit(0)), F.lit(0))
    n = df.join(F.broadcast(edges)).withColumn("__b", at).groupBy("batch").pivot("__b", list(range(bins))).count().na.fill(0)
    total = sum((F.col(str(i)) for i in range(bins)), F.lit(0))
    p = F.array(*[F.col(str(i)) / total for i in range(bins)])
    n = n.select("batch", p.alias("__p")).withColumn("__q", F.lag("__p").over(_in_order())).withColumn("__i", F.row_number().over(_in_order()))
    term = lambda a, m: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    parts = F.zip_with("__p", "__q", lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    js = F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))
    return n.select("batch", F.when(F.col("__i") <= 2, 1.0).otherwise(1 - js).alias("stability"))


#: Weights of change, distribution, online, density and bayes in the overall figure.
WEIGHTS = (0.25, 0.25, 0.15, 0.2, 0.15)


def overall(change: Column, distribution: Column, online: Column, density: Column, bayes: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """The report's one figure; a change counts against it."""
    parts = (1 - change, distribution, online, density, bayes)
    return sum((w * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0))


def report(df: DataFrame, k: int) -> DataFrame:
    """A row for each batch of (batch, cluster, features): the five detectors and the overall stability."""
    values = df.select("batch", array_mean(F.col("features")).alias("value"))
    out = cusum(df)
    for name, part in (
        ("distribution", label_stability(df, k)), ("online", histogram_drift(values)), ("density", density_stability(df).drop("density")), ("bayes", bayes_stability(df, k)),
    ):
        out = out.join(part.withColumnRenamed("stability", name), "batch")
    return out.withColumn("overall", overall(*[F.col(c) for c in ("change", "distribution", "online", "density", "bayes")]))


def memory_weights(df: DataFrame, stability: Column | float = 1.0, column: str = "features", history: int = 1000) -> DataFrame:
    """(batch, weight): the weight of each of a batch's rows; the rows' weights sum to 1.

    It comes from a decay over the batches before, from how far values deviate, and from stability."""
    v = df.select("batch", F.explode(column).alias("x"))
    m = v.groupBy("batch").agg(F.avg("x").alias("__m"), F.stddev_pop("x").alias("__s"))
    off = v.join(m, "batch").groupBy("batch").agg(F.avg(F.abs(F.col("x") - F.col("__m")) / (F.col("__s") + EPS)).alias("__d"))
    n = df.groupBy("batch").agg(F.count(F.lit(1)).alias("__n")).join(off, "batch")
    h = F.least(F.row_number().over(_in_order()) - 1, F.lit(history))
    n = n.withColumn("__h", h)
    decay = F.when(F.col("__h") == 0, 1.0).otherwise((1 - F.exp(F.col("__h") * -0.1)) / (F.nullif(F.col("__h"), F.lit(0)) * (1 - math.exp(-0.1))))
    raw = decay * F.exp(-F.col("__d")) * (F.lit(stability) if isinstance(stability, float) else stability)
    return n.select("batch", (raw / (F.col("__n") * raw + EPS)).alias("weight"))
