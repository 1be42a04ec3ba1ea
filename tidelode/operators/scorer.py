"""Movement scorer: a ridge regression of a composite target on movement features.

The Gram matrix and the right-hand side are sums of one aggregation; only they reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelode.schema import EPS, MOVEMENT, DataError


def price_change(future: Column) -> Column:
    """Last less first vertical movement of the future vectors."""
    return F.element_at(future, -1)[0] - F.element_at(future, 1)[0]


def target_scores(df: DataFrame, change: str = "change", future: str = "future", weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """df with target: weighted z-scores of the change, of the share of future moves along it, of its efficiency."""
    verticals = F.transform(future, lambda m: m[0])
    path = F.aggregate(F.transform(verticals, F.abs), F.lit(0.0), lambda a, x: a + x)
    along = F.size(F.filter(verticals, lambda x: F.signum(x) == F.signum(F.col(change)))) / F.size(verticals)
    df = df.withColumns({"consistency": along, "efficiency": F.abs(change) / (path + EPS)})
    names = (change, "consistency", "efficiency")
    stats = df.agg(*[f(n).alias(f"__{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    df = df.join(F.broadcast(stats))  # one row
    z = sum((w * (F.col(n) - F.col(f"__m{i}")) / (F.col(f"__s{i}") + EPS) for i, (n, w) in enumerate(zip(names, weights, strict=True))), F.lit(0.0))
    return df.withColumn("target", z).drop(*[f"__{k}{i}" for k in "ms" for i in range(3)])


def gram(df: DataFrame, features: str = "features", target: str = "target", d: int = len(MOVEMENT)) -> DataFrame:
    """One row: g_i_j for i <= j, b_i, n."""
    x = [F.col(features)[i] for i in range(d)]
    sums = [F.sum(x[i] * x[j]).alias(f"g_{i}_{j}") for i in range(d) for j in range(i, d)]
    return df.agg(*sums, *[F.sum(x[i] * F.col(target)).alias(f"b_{i}") for i in range(d)], F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class MovementScorer:
    """weights: one for each feature; mean and std of the raw scores it was fitted on."""

    weights: tuple[float, ...]
    mean: float
    std: float
    threshold: float = 0.6

    @classmethod
    def fit(cls, df: DataFrame, min_samples: int = 100, l2: float = 0.01, features: str = "features", d: int = len(MOVEMENT)) -> MovementScorer:
        """df: (features, future, change)."""
        t = target_scores(df)
        row = gram(t, features, d=d).first().asDict()
        if row["n"] < min_samples:
            raise DataError(f"{row['n']} samples; {min_samples} are needed")
        g = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        w = np.linalg.solve(g + l2 * np.eye(d), np.array([row[f"b_{i}"] for i in range(d)]))
        mean, std = df.agg(F.avg(raw_score(F.col(features), w)), F.stddev_pop(raw_score(F.col(features), w))).first()
        return cls(tuple(map(float, w)), float(mean), float(std))

    def score(self, features: Column) -> Column:
        return clipped((raw_score(features, self.weights) - self.mean) / (self.std + EPS))

    def score_sequence(self, vectors: Column) -> Column:
        """Mean raw score of a sequence's vectors, normalised and clipped."""
        total = F.aggregate(F.transform(vectors, lambda v: raw_score(v, self.weights)), F.lit(0.0), lambda a, x: a + x)
        return clipped((total / F.size(vectors) - self.mean) / (self.std + EPS))

    def importance(self) -> dict[str, float]:
        from tidelode.operators.cluster import importance

        return dict(zip(MOVEMENT, importance(list(self.weights)), strict=False))


def raw_score(features: Column, weights) -> Column:
    return F.aggregate(F.zip_with(features, F.lit([float(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)


def clipped(z: Column) -> Column:
    return F.least(F.greatest(z / 2, F.lit(-1.0)), F.lit(1.0))
