"""The pipeline: series to windows to features to clusters to what clusters earn, fitted and applied.

All methods take and return DataFrames; a fitted model is a few lists of numbers and two tables of a
row for each series.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.operators import cleaning, cluster, evaluate, features, reducers, windows
from tidelode.operators.ordered import SERIES
from tidelode.operators.scorer import MovementScorer
from tidelode.schema import DataError
from tidelode.sources import models
from tidelode.sources.scratch import stored


class ModelType(Enum):
    STANDARD = "standard"
    TS = "ts"
    SEQUENTIAL = "sequential"


class ReducerType(Enum):
    FFT = "FFT"
    PIP = "PIP"
    WAVELET = "Wavelet"
    FFT_WAVELET = "FFTWavelet"
    MVR = "MVR"


class EvaluatorType(Enum):
    HOLDING_PERIOD = "holding_period"
    VECTOR_PATTERN = "vector_pattern"


WAVELETS = ("db1", "db2", "coif1", "haar", "sym5")


@dataclass(frozen=True)
class HoldingPeriodConfig:
    min_samples: int = 50
    baseline_threshold: float = 0.0

    def __post_init__(self):
        _check(self.min_samples >= 1, "min_samples must be 1 or more")
        _check(0 <= self.baseline_threshold <= 1, "baseline_threshold must be between 0 and 1")


@dataclass(frozen=True)
class VectorPatternConfig:
    n_future_vectors: int = 5
    n_features: int = 8
    min_samples: int = 50
    confidence: float = 0.95

    def __post_init__(self):
        _check(self.n_future_vectors >= 1, "n_future_vectors must be 1 or more")
        _check(1 <= self.n_features <= 8, "n_features must be 1 to 8")
        _check(self.min_samples >= 1, "min_samples must be 1 or more")
        _check(0 < self.confidence < 1, "confidence must be between 0 and 1")


def _name(kind: Enum | str) -> str:
    return kind.value if isinstance(kind, Enum) else kind


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise DataError(what)


@dataclass(frozen=True)
class Config:
    n_lookback: int = 25
    n_pivots: int = 4
    n_clusters: int = 8
    hold_period: int = 6
    model_type: ModelType = ModelType.STANDARD
    reducer_type: ReducerType = ReducerType.PIP
    evaluator_type: EvaluatorType = EvaluatorType.HOLDING_PERIOD
    evaluator_params: dict = field(default_factory=dict)
    wavelet: str = "coif1"
    distance: str = "euclidean"
    dist_measure: int = 1
    normalize_window: int = 100
    min_movement: float = 0.001
    feature_selection: tuple[str, ...] | None = None
    trend_window: int = 20
    mvr_alpha: float = 0.1
    scale_domain: str = "asinh"
    seed: int = 14

    def __post_init__(self):
        for name, kind, own in (("model_type", ModelType, ()), ("reducer_type", ReducerType, reducers.CUSTOM), ("evaluator_type", EvaluatorType, evaluate.CUSTOM)):
            if getattr(self, name) in own:
                continue
            try:
                object.__setattr__(self, name, kind(getattr(self, name)))
            except ValueError as e:
                raise DataError(str(e)) from e
        _check(self.n_lookback > 0 and self.n_pivots > 0, "n_lookback and n_pivots must be positive")
        _check(self.n_clusters > 1, "n_clusters must be 2 or more")
        _check(self.hold_period >= 0, "hold_period must not be negative")
        _check(self.wavelet in WAVELETS, f"wavelet must be one of {WAVELETS}")
        _check(0 < self.min_movement < 1 and 0 < self.mvr_alpha < 1, "min_movement and mvr_alpha must be between 0 and 1")
        self.evaluator()

    def evaluator(self) -> HoldingPeriodConfig | VectorPatternConfig | None:
        """The evaluator's settings; None of one that was registered, which has evaluator_params."""
        if self.evaluator_type in evaluate.CUSTOM:
            return None
        kind = HoldingPeriodConfig if self.evaluator_type is EvaluatorType.HOLDING_PERIOD else VectorPatternConfig
        try:
            return kind(**self.evaluator_params)
        except TypeError as e:
            raise DataError(str(e)) from e

    def to_dict(self) -> dict:
        return {k: v.value if isinstance(v, Enum) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, d: dict) -> Config:
        unknown = set(d) - set(cls.__dataclass_fields__)
        _check(not unknown, f"unknown settings: {sorted(unknown)}")
        d = dict(d)
        if d.get("feature_selection") is not None:
            d["feature_selection"] = tuple(d["feature_selection"])
        return cls(**d)


class Miner:
    """fit on series (series_id, pos, value); returns default to the scaled values' differences."""

    def __init__(self, config: Config | dict | None = None):
        self.config = Config.from_dict(config) if isinstance(config, dict) else config or Config()
        self.centers: list[list[float]] | None = None
        self.long: list[int] = []
        self.short: list[int] = []
        self.stats: list[dict] = []
        self.scaling: DataFrame | None = None
        self.scorer: MovementScorer | None = None
        self._training: DataFrame | None = None

    # features
    def _scaled(self, data: DataFrame, train: bool) -> DataFrame:
        cleaning.require_finite(data, "value")
        if train:
            self.scaling = cleaning.scaling(data, "value", self.config.scale_domain)
        return cleaning.asinh_scale(data, "value", self.scaling, self.config.scale_domain)

    def _features(self, scaled: DataFrame) -> DataFrame:
        c = self.config
        w = windows.sliding(scaled, c.n_lookback, "scaled")
        movement = dict(features=c.feature_selection, normalize_window=c.normalize_window, min_movement=c.min_movement, trend_window=min(c.trend_window, c.n_lookback), alpha=c.mvr_alpha)
        how = movement if c.reducer_type is ReducerType.MVR else {}
        reduce = reducers.reducer(_name(c.reducer_type), c.n_pivots, c.wavelet, reducers.DistanceMeasure(c.dist_measure), **how)
        return features.transform_windows(w, reduce, c.n_pivots)

    def _returns(self, scaled: DataFrame, returns: DataFrame | None) -> DataFrame:
        if returns is not None:
            return returns
        d = windows.difference(scaled, "scaled", "__d")
        from tidelode.operators.ordered import framed

        return framed(d, {"returns": lambda w: F.coalesce(F.lead("__d").over(w), F.lit(0.0))}, after=1)

    # the model
    def fit(self, data: DataFrame, returns: DataFrame | None = None, start: list[list[float]] | None = None, max_iter: int | None = None) -> float | None:
        """Fit on data; the martin ratio of the chosen clusters' strategy, None without one.

        returns: (series_id, pos, returns), the return from each position to the next. start: centers that the
        sequential model begins with."""
        c = self.config
        scaled = self._scaled(data, train=True).persist()
        rows = self._features(scaled).persist()
        try:
            self._training = data
            self.centers = cluster.fit(rows, c.n_clusters, c.model_type.value, c.distance, seed=c.seed, start=start, max_iter=max_iter)
            labels = self._assign(rows)
            r = self._returns(scaled, returns)
            self._select(labels, scaled, r)
            row = evaluate.metrics.performance(self._pooled(labels, r), ["all"]).select("martin").first() if self.long or self.short else None
            return row and row[0]
        finally:
            rows.unpersist()
            scaled.unpersist()

    def _pooled(self, labels: DataFrame, returns: DataFrame) -> DataFrame:
        r = evaluate.strategy_returns(labels, returns, self.long, self.short).withColumn("all", F.lit(0))
        return evaluate._pooled(r, ("all",)).withColumn("pos", F.col("__p")).drop("__p")

    def _assign(self, rows: DataFrame) -> DataFrame:
        return cluster.assign(rows, self.centers, metric=self.config.distance)

    def _select(self, labels: DataFrame, scaled: DataFrame, returns: DataFrame) -> None:
        e = self.config.evaluator()
        if e is None:
            rows = evaluate.CUSTOM[self.config.evaluator_type](labels, scaled, returns, self.config.evaluator_params)
            self.stats = [r.asDict() for r in rows.orderBy(F.desc("score"), "cluster").collect()]  # at most a row for each cluster
        elif isinstance(e, HoldingPeriodConfig):
            both = evaluate.holding_metrics(labels, returns, self.config.hold_period, e.min_samples)
            best = evaluate.select_clusters(evaluate.better_side(both), e.baseline_threshold)
            self.stats = evaluate.with_interval([r.asDict() for r in best.collect()])  # at most a row for each cluster
        else:
            samples = self.pattern_samples(labels, scaled).persist()
            self.scorer = MovementScorer.fit(samples, e.min_samples)
            rows = evaluate.pattern_performance(samples, self.scorer).where(F.col("n") >= e.min_samples)
            rows = evaluate.significant_patterns(evaluate.with_t_interval(rows, confidence=e.confidence))
            self.stats = [r.asDict() for r in rows.orderBy(F.desc("score"), "cluster").collect()]  # at most a row for each cluster
            samples.unpersist()
        self.long = [r["cluster"] for r in self.stats if r["side"] == 1]
        self.short = [r["cluster"] for r in self.stats if r["side"] == -1]

    def pattern_samples(self, labels: DataFrame, scaled: DataFrame) -> DataFrame:
        n = self.config.evaluator().n_future_vectors
        pairs = evaluate.window_pairs(labels, scaled.select(SERIES, "pos", F.col("scaled").alias("value")), n, self.config.min_movement)
        return evaluate.pattern_samples(pairs, n)

    def _fitted(self) -> None:
        if self.centers is None:
            raise DataError("the model is not fitted")

    def transform(self, data: DataFrame) -> DataFrame:
        """(series_id, pos, features) of the windows that are left, by the training's scaling."""
        self._fitted()
        return self._features(self._scaled(data, train=False))

    def predict(self, data: DataFrame) -> DataFrame:
        """(series_id, pos, features, cluster, distance)."""
        return self._assign(self.transform(data))

    def evaluate(self, data: DataFrame, returns: DataFrame | None = None) -> DataFrame:
        """Holding metrics of every cluster and direction on other data; the selection stays that of the fit."""
        self._fitted()
        scaled = self._scaled(data, train=False)
        labels = stored(self._assign(self._features(scaled)).select(SERIES, "pos", "cluster"), "labels")
        chosen = evaluate.cluster_signal(F.col("cluster"), self.long, self.short)
        e = self.config.evaluator()
        return evaluate.holding_metrics(labels, self._returns(scaled, returns), self.config.hold_period, e.min_samples if e else 1).withColumn("selected", chosen)

    def signals(self, data: DataFrame) -> DataFrame:
        """(series_id, pos, features, signal, confidence) of every window, by the features of the fit."""
        return cluster.signals(self.transform(data), self.centers, self.long, self.short)

    def report(self, data: DataFrame, returns: DataFrame | None = None) -> DataFrame:
        """One row of all metrics of the strategy on data."""
        scaled = self._scaled(data, train=False)
        labels = self._assign(self._features(scaled))
        return evaluate.metrics.performance(self._pooled(labels, self._returns(scaled, returns)), ["all"]).drop("all")

    # what there is to know of the model
    def get_params(self) -> dict:
        return self.config.to_dict()

    def set_params(self, **changes) -> Miner:
        """Other settings; what was fitted by the old ones is dropped."""
        self.__init__(self.config.to_dict() | changes)
        return self

    @property
    def cluster_centers(self) -> list[list[float]]:
        self._fitted()
        return self.centers

    @property
    def labels(self) -> DataFrame:
        """(series_id, pos, cluster) of the training data."""
        return self._assign(self.training_data()).select(SERIES, "pos", "cluster")

    def training_data(self, processed: bool = True) -> DataFrame:
        """The features that the model was fitted on, or the series itself."""
        if self._training is None:
            raise DataError("no training data: the model was loaded, or is not fitted")
        return self.transform(self._training) if processed else self._training

    def cluster_metrics(self, cluster_id: int) -> dict | None:
        return next((r for r in self.stats if r["cluster"] == cluster_id), None)

    def cluster_signal(self, cluster_id: int) -> int:
        return 1 if cluster_id in self.long else -1 if cluster_id in self.short else 0

    def summary(self) -> dict:
        """How many clusters were chosen, which, and the best score."""
        return {"n_clusters": self.config.n_clusters, "n_selected": len(self.stats), "long": self.long, "short": self.short, "best_score": max((r["score"] for r in self.stats), default=None)}

    # on disk
    def save(self, path: str) -> int:
        """Write the model as a new version under path; returns its number."""
        self._fitted()
        state = {"config": self.config.to_dict(), "centers": self.centers, "long": self.long, "short": self.short, "stats": self.stats, "scorer": self.scorer and asdict(self.scorer)}
        return models.save(self.scaling.sparkSession, state, path, {"scaling": self.scaling})

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> Miner:
        state = models.load(spark, path, version)
        m = cls(state["config"])
        m.centers, m.long, m.short, m.stats = state["centers"], state["long"], state["short"], state.get("stats", [])
        if state.get("scorer"):
            m.scorer = MovementScorer(**state["scorer"] | {"weights": tuple(state["scorer"]["weights"])})
        m.scaling = models.load_table(spark, path, "scaling", version)
        return m


CV_METRICS = ("martin", "sharpe", "profit_factor", "win_rate", "max_drawdown")


def cross_validation(config: Config, data: DataFrame, splits: int = 5, centers: list[list[float]] | None = None, returns: DataFrame | None = None) -> DataFrame:
    """(fold, metrics): the strategy's metrics on each fold's test part, by a model of all before, for all folds at once.

    A fold is part of a series' name, and of a cluster's number, so that every operator of the pipeline works on
    all folds in one pass; what comes to the driver is a row for each fold and center. centers: the same for each
    fold, instead of fitted ones; returns: (series_id, pos, returns), else those of the scaled values. For Euclidean
    distances and holding periods."""
    e = config.evaluator()
    if not isinstance(e, HoldingPeriodConfig) or config.distance != "euclidean":
        raise DataError("folds are evaluated at once by holding periods and Euclidean distances")
    m = Miner(config)
    data = data.select(SERIES, "pos", "value")
    if returns is not None:
        data = data.join(returns.select(SERIES, "pos", "returns"), [SERIES, "pos"])
    parts = windows.folds(data, splits)
    keyed = parts.withColumn(SERIES, F.concat_ws("|", F.col("fold").cast("string"), F.col(SERIES)))
    start = keyed.where("part = 'test'").groupBy(SERIES).agg(F.min("pos").alias("__p"))
    train = keyed.where("part = 'train'")
    test = keyed.where("part = 'test'").join(start, SERIES).withColumn("pos", F.col("pos") - F.col("__p"))
    given = lambda df: None if returns is None else df
    of_fold = lambda df: df.withColumn("fold", F.split(F.col(SERIES), r"\|", 2)[0].cast("int"))
    scaled = m._scaled(train, train=True).persist()
    rows = of_fold(m._features(scaled)).persist()
    try:
        found = [centers] * splits if centers is not None else cluster.fit_folds(rows, config.n_clusters, splits, seed=config.seed)
        labels = cluster.assign_by_fold(rows, found)
        both = evaluate.holding_metrics(labels, m._returns(scaled, given(train)), config.hold_period, e.min_samples)
        chosen = evaluate.select_clusters(evaluate.better_side(both), e.baseline_threshold).select("cluster", "side").collect()
    finally:
        rows.unpersist()
        scaled.unpersist()
    sides = {side: [r["cluster"] for r in chosen if r["side"] == side] for side in (1, -1)}
    scaled = m._scaled(test, train=False)
    labels = cluster.assign_by_fold(of_fold(m._features(scaled)), found)
    r = of_fold(evaluate.strategy_returns(labels, m._returns(scaled, given(test)), sides[1], sides[-1]))
    r = evaluate._pooled(r, ("fold",)).withColumn("pos", F.col("__p")).drop("__p")
    return evaluate.metrics.performance(r, ["fold"])


def cv_table(folds: DataFrame, names: tuple[str, ...] = CV_METRICS) -> DataFrame:
    """(fold, metric, value, mean, std): each metric of each fold, and its mean and population deviation over the folds that have it."""
    each = folds.select("fold", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("fold", "m.*")
    over = each.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return each.join(F.broadcast(over), "metric").select("fold", "metric", "value", "mean", "std")  # a row for each metric


def cross_validate(config: Config, data: DataFrame, splits: int = 5) -> list[dict]:
    """The strategy's metrics on each fold's test part, of a model fitted on all before; folds are few.

    Of what cross_validation can't do at once, each fold has its own fit."""
    if isinstance(config.evaluator(), HoldingPeriodConfig) and config.distance == "euclidean":
        found = {r["fold"]: r for r in cross_validation(config, data, splits).collect()}
        return [{"fold": f} | {k: found[f][k] if f in found else None for k in CV_METRICS} for f in range(splits)]
    out = []
    parts = windows.folds(data, splits).persist()
    for fold in range(splits):
        train = parts.where((F.col("fold") == fold) & (F.col("part") == "train")).select(SERIES, "pos", "value")
        test = parts.where((F.col("fold") == fold) & (F.col("part") == "test"))
        start = test.groupBy(SERIES).agg(F.min("pos").alias("__p"))
        test = test.join(start, SERIES).select(SERIES, (F.col("pos") - F.col("__p")).alias("pos"), "value")
        m = Miner(replace(config))
        m.fit(train)
        row = m.report(test).first()
        out.append({"fold": fold} | {k: row[k] if row else None for k in CV_METRICS})
    parts.unpersist()
    return out


def cv_summary(rows: list[dict]) -> dict[str, tuple[float, float] | None]:
    """Mean and population deviation of each metric over the folds that have it."""
    out = {}
    for k in CV_METRICS:
        v = [r[k] for r in rows if r[k] is not None]
        mean = sum(v) / len(v) if v else 0.0
        out[k] = (mean, (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5) if v else None
    return out


def run_mining_test(data: DataFrame, config: Config | dict, path: str | None = None) -> dict:
    """Split 70 to 30, fit, evaluate on the rest, save: the whole pipeline once."""
    m = Miner(config)
    parts = windows.split(data)
    train = parts.where("part = 'train'").select(SERIES, "pos", "value")
    start = parts.where("part = 'test'").groupBy(SERIES).agg(F.min("pos").alias("__p"))
    test = parts.where("part = 'test'").join(start, SERIES).select(SERIES, (F.col("pos") - F.col("__p")).alias("pos"), "value")
    martin = m.fit(train)
    out = {"martin": martin, "evaluation": m.evaluate(test), "miner": m}
    if path:
        m.save(path)
    return out
