"""Streams: bars with watermarks, movement vectors with keyed state, centers that adapt batch by batch."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelode.functions import kernels
from tidelode.operators import cluster
from tidelode.operators.ordered import SERIES
from tidelode.schema import EPS, DataError, array_mean
from tidelode.sources.states import States
from tidelode.streaming import stability


def stream_bars(ticks: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Bars of a stream (series_id, ts, value), in windows from 1970, closed when the watermark has passed."""
    t = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    order = F.col("ts")
    bars = t.groupBy(SERIES, F.window("ts", width)).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return bars.select(SERIES, F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def distinct_ticks(ticks: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """A stream without repeats of keys that come within the watermark."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class _Movements(StatefulProcessor):
    """A ring of the last values of a series and the state of its movement vectors, as JSON."""

    def __init__(self, length: int, settings: dict):
        self.length, self.settings = length, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved = json.loads(self.state.get()[0]) if self.state.exists() else {}
        ring, m = saved.get("ring", []), kernels.MovementState(**self.settings)
        if saved:
            m.windows.extend(np.array(w) for w in saved["windows"])
            m.recent.extend(saved["recent"])
            m.stats, m.last_speed = saved["stats"], saved["last_speed"]
        batch = pd.concat(list(rows)).sort_values("pos")
        out = []
        for pos, value in zip(batch["pos"], batch["value"], strict=True):
            ring = [*ring, float(value)][-self.length :]
            if len(ring) == self.length:
                out.append((key[0], pos, m.step(np.array(ring))))
        plain = {k: float(v) for k, v in m.stats.items()}
        self.state.update((json.dumps({"ring": ring, "windows": [w.tolist() for w in m.windows], "recent": [float(x) for x in m.recent], "stats": plain, "last_speed": m.last_speed}),))
        if out:
            yield pd.DataFrame(out, columns=[SERIES, "pos", "features"])

    def close(self) -> None:
        pass


def stream_movements(values: DataFrame, length: int, n_pivots: int, **settings) -> DataFrame:
    """Movement vectors of a stream (series_id, pos, value) that comes in order of pos in each series."""
    return values.groupBy(SERIES).transformWithStateInPandas(
        _Movements(length, {"n": n_pivots} | settings), outputStructType="series_id string, pos long, features array<double>", outputMode="Update", timeMode="None"
    )


class Detectors:
    """The stability detectors one batch at a time: a batch's aggregates (k and BINS numbers) against the last one's."""

    BINS = 20

    def __init__(self, k: int, threshold: float = 2.0, history: int = 1000):
        self.k, self.threshold = k, threshold
        self.means: deque[float] = deque(maxlen=history)
        self.above = self.below = 0.0
        self.shares = self.posterior = self.edges = self.hist = None
        self.density = None
        self.seen = 0

    def state(self) -> dict:
        plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
        return {name: plain(getattr(self, name)) for name in ("above", "below", "shares", "posterior", "edges", "hist", "density", "seen")} | {"means": list(self.means)}

    def restore(self, state: dict) -> None:
        for name, value in state.items():
            if name == "means":
                self.means = deque(value, maxlen=self.means.maxlen)
            else:
                setattr(self, name, np.array(value) if name in ("shares", "posterior", "hist") and value is not None else value)

    def update(self, labelled: DataFrame) -> dict[str, float]:
        """labelled: (cluster, features) of one batch, read three times."""
        rows = labelled.withColumn("batch", F.lit(0))
        of = {r["cluster"]: r for r in stability.radii(rows).collect()}  # k rows
        n = np.array([of[c]["n"] if c in of else 0 for c in range(self.k)], float)
        radius = np.array([of[c]["radius"] if c in of else np.inf for c in range(self.k)])
        v = rows.select(array_mean(F.col("features")).alias("value"))
        mean, low, high = v.agg(F.avg("value"), F.min("value"), F.max("value")).first()
        out = {"change": self._change(mean), "distribution": 1.0, "online": 1.0, "density": 1.0}
        shares = n / max(n.sum(), 1)
        if self.shares is not None:
            out["distribution"] = 1 - float(np.abs(shares - self.shares).mean())
        if self.edges is None:
            self.edges = (low, high)
        width = (self.edges[1] - self.edges[0]) / self.BINS or 1.0
        at = F.greatest(F.least(F.floor((F.col("value") - self.edges[0]) / width), F.lit(self.BINS - 1)), F.lit(0)).cast("int")
        hist = np.zeros(self.BINS)
        for i, c in v.groupBy(at).count().collect():  # BINS rows
            hist[i] = c
        hist /= max(hist.sum(), 1)
        if self.seen >= 2:
            m = (hist + self.hist) / 2
            parts = [np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / np.where(m > 0, m, 1)), 0).sum() for p in (hist, self.hist)]
            out["online"] = 1 - float(np.sqrt(max(sum(parts) / 2, 0)))
        wide = n >= 2
        density = float((1 / (radius[wide] + EPS)).mean()) if wide.any() else 0.0
        if self.density is not None:
            out["density"] = 1 - abs(density - self.density)
        prior = np.full(self.k, 1 / self.k) if self.posterior is None else self.posterior
        post = prior * (np.exp(-np.where(np.isfinite(radius), radius, 1e3) ** 2 / 2) / np.sqrt(2 * np.pi) + EPS)
        post /= post.sum()
        out["bayes"] = 1 - float(np.abs(post - prior).mean())
        self.shares, self.hist, self.density, self.posterior = shares, hist, density, post
        self.seen += 1
        out["overall"] = 0.25 * (1 - out["change"]) + 0.25 * out["distribution"] + 0.15 * out["online"] + 0.2 * out["density"] + 0.15 * out["bayes"]
        return out

    def _change(self, mean: float) -> float:
        if len(self.means) < 2:
            self.means.append(mean)
            return 0.0
        z = (mean - np.mean(self.means)) / (np.std(self.means) or EPS)
        self.above, self.below = max(0.0, self.above + z), max(0.0, self.below - z)
        self.means.append(mean)
        return float(min(max(self.above, self.below) / self.threshold, 1.0))


class AdaptiveCenters:
    """Centers that follow the data: each batch moves them by a rate that grows with change.

    rate = learning_rate * (1 - overall stability) * (1 + change score); a center moves by rate towards
    the mean of its rows of the batch. keep is told each new version of the centers.

    With states, what a batch leaves behind is kept under its number, and a batch begins with what the last one
    before it has left, wherever that ran: after a restart the centers go on from there, and a batch that comes
    again moves them as it did the first time. The centers given here then only begin an empty folder."""

    def __init__(self, centers: list[list[float]], learning_rate: float = 0.01, keep: Callable[[int, list], None] | None = None, states: States | None = None):
        self.centers, self.learning_rate, self.keep, self.states = [list(c) for c in centers], learning_rate, keep, states
        self.detectors = Detectors(len(centers))
        self.version = 0
        self.last: dict[str, float] = {}
        if states is not None:
            if (found := states.latest()) is None:
                states.put(-1, self._state())
            else:
                self._restore(found[1])

    def _state(self) -> dict:
        return {"centers": self.centers, "version": self.version, "last": self.last, "detectors": self.detectors.state()}

    def _restore(self, state: dict) -> None:
        self.centers, self.version, self.last = [list(c) for c in state["centers"]], state["version"], state["last"]
        self.detectors = Detectors(len(self.centers))
        self.detectors.restore(state["detectors"])

    def step(self, batch: DataFrame, column: str = "features", number: int | None = None) -> DataFrame:
        """Labels of the batch by the centers so far; then the centers move. An empty batch changes nothing.

        number: the batch's number, 0 or more, which states go by."""
        if self.states is not None:
            if number is None:
                raise DataError("batches have numbers where states are kept")
            self._restore(self.states.latest(before=number)[1])
        labelled = cluster.assign(batch, self.centers, column)
        if batch.isEmpty():
            return labelled
        rows = labelled.select("cluster", F.col(column).alias("features"))
        self.last = self.detectors.update(rows)
        rate = self.learning_rate * (1 - min(max(self.last["overall"], 0.0), 1.0)) * (1 + self.last["change"])
        for c, center in cluster.update_centers(rows, "features").collect():  # k rows
            self.centers[c] = [(1 - rate) * a + rate * b for a, b in zip(self.centers[c], center, strict=True)]
        self.version += 1
        if self.states is not None:
            self.states.put(number, self._state())
        if self.keep:
            self.keep(self.version, self.centers)
        return labelled


def adapt_stream(features: DataFrame, adaptive: AdaptiveCenters, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that labels and adapts batch by batch, and hands the labels and the batch's number to sink."""
    step = lambda df, i: sink(adaptive.step(df, number=i), i)
    return features.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(spark: SparkSession, df: DataFrame, column: str = "batch") -> Iterator[DataFrame]:
    """df's batches one after another, as a stream would bring them."""
    for (b,) in df.select(column).distinct().orderBy(column).collect():
        yield df.where(F.col(column) == b)
