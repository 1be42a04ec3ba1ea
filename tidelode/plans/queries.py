"""Queries of the series operators over the driver's tables, and their SQL.

Series are events by type, ordered by time; returns are differences of asinh(value) over 10. Arrays
come back a row for each element. Numbers are rounded to six places where the order of summation may
show.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.functions import kernels, metrics
from tidelode.operators import bars, cleaning, cluster, distance, evaluate, features, hold, reducers, scorer, windows
from tidelode.operators.ordered import SERIES, framed, number_rows
from tidelode.plans import charts, miner, registry
from tidelode.plans.registry import query
from tidelode.schema import MOVEMENT
from tidelode.streaming import stability

HOUR = 3600 * 1_000_000
LENGTH = 8
E_SQL = "e AS (SELECT event_type AS series_id, ts, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events)"
R_SQL = E_SQL + ", r AS (SELECT series_id, pos, value, coalesce(asinh(value) - lag(asinh(value)) OVER (PARTITION BY series_id ORDER BY pos), 0) / 10 AS returns FROM e)"
BAR_SQL = f"""b AS (SELECT event_type AS series_id, t0, floor((epoch_us(ts) - t0) / {HOUR})::BIGINT AS bin, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events JOIN (SELECT event_type, min(epoch_us(ts)) AS t0 FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2, 3),
h AS (SELECT series_id, make_timestamp(t0 + bin * {HOUR}) AS ts, open, high, low, close, volume, row_number() OVER (PARTITION BY series_id ORDER BY bin) - 1 AS pos FROM b)"""
L_SQL = R_SQL + ", l AS (SELECT series_id, pos, value, returns, floor(value)::BIGINT % 4 AS cluster FROM r)"
# windows of LENGTH values, a row for each
W_SQL = R_SQL + f", w AS (SELECT series_id, pos, x FROM (SELECT series_id, pos, list(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS x FROM e) WHERE len(x) = {LENGTH})"


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def s6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(F.col("event_type").alias(SERIES), "ts", "event_id", "value")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return number_rows(_ticks(spark, d), "event_id")


def _returns(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(SERIES, "pos", "value").withColumn("__a", F.asinh("value"))
    return windows.difference(e, "__a", "__d").select(SERIES, "pos", "value", (F.col("__d") / 10).alias("returns"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _returns(spark, d).withColumn("cluster", (F.floor("value") % 4).cast("int"))


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return bars.ticks_to_bars(_ticks(spark, d), "1h", ("event_id",))


def _windows(spark: SparkSession, d: str, n: int = LENGTH) -> DataFrame:
    return windows.sliding(_events(spark, d), n)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def _centers(spark: SparkSession, d: str) -> list[list[float]]:
    """The vectors of ids 0 to 3: fixed centers that SQL can have as well."""
    return [list(r[0]) for r in _vectors(spark, d).where("vec_id < 4").orderBy("vec_id").select("features").collect()]


def _each(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("i", "x")).select(*keys, "i", r6(F.col("x")).alias("x"))


# bars


@query("ohlcv_bars", f"WITH {BAR_SQL} SELECT series_id, ts, open, high, low, close, volume FROM h")
def ohlcv_bars(spark, d):
    return _hours(spark, d)


@query(
    "ohlcv_bars_buffered",
    """WITH t AS (SELECT event_type, min(epoch_us(ts)) AS t0 FROM events GROUP BY 1)
SELECT event_type AS series_id, make_timestamp(t0 + 300000000 + floor((epoch_us(ts) - t0 - 300000000) / 3600000000)::BIGINT * 3600000000) AS ts, arg_min(value, (ts, event_id)) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
FROM events JOIN t USING (event_type) GROUP BY event_type, t0, floor((epoch_us(ts) - t0 - 300000000) / 3600000000)""",
)
def ohlcv_bars_buffered(spark, d):
    return bars.ticks_to_bars(_ticks(spark, d), "1h", ("event_id",), 300)


@query(
    "bars_resample",
    f"""WITH {BAR_SQL}, t AS (SELECT series_id, min(epoch_us(ts)) AS o FROM h GROUP BY 1)
SELECT series_id, make_timestamp(o + floor((epoch_us(ts) - o) / {4 * HOUR})::BIGINT * {4 * HOUR}) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, sum(volume) AS volume FROM h JOIN t USING (series_id) GROUP BY series_id, o, floor((epoch_us(ts) - o) / {4 * HOUR})""",
)
def bars_resample(spark, d):
    return bars.resample(_hours(spark, d), "1h", "4h")


@query(
    "lineitem_daily_bars",
    """SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high,
  min(l_extendedprice) AS low, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2""",
)
def lineitem_daily_bars(spark, d):
    t = _table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias(SERIES), F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("volume"), "l_orderkey", "l_linenumber"
    )
    return bars.ticks_to_bars(t, "1day", ("l_orderkey", "l_linenumber"))


@query("forward_returns", f"WITH {BAR_SQL} SELECT series_id, pos, CASE WHEN lead(pos) OVER w IS NULL THEN 0.0 ELSE {s6('lead(close) OVER w / nullif(close, 0) - 1')} END AS returns FROM h WINDOW w AS (PARTITION BY series_id ORDER BY pos)")
def forward_returns(spark, d):
    return bars.forward_returns(number_rows(_hours(spark, d))).select(SERIES, "pos", r6(F.col("returns")).alias("returns"))


_DAILY = "c AS (SELECT event_type AS series_id, date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)"


def _days(spark, d):
    t = _ticks(spark, d).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return t.groupBy(SERIES, "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")).select(SERIES, F.col("day").alias("ts"), "value")


@query("asof_align", f"WITH {E_SQL}, {_DAILY} SELECT e.series_id, e.event_id, c.value AS aligned FROM e ASOF LEFT JOIN c ON e.series_id = c.series_id AND e.ts >= c.ts + INTERVAL 1 MINUTE")
def asof_align(spark, d):
    return bars.align(_ticks(spark, d), _days(spark, d), "1min").select(SERIES, "event_id", "aligned")


@query(
    "asof_align_strict",
    f"""WITH {E_SQL}, {_DAILY}, m AS (SELECT series_id, max(ts) AS last, epoch_us(min(ts)) AS g FROM c GROUP BY 1), k AS (SELECT c.* FROM c JOIN m USING (series_id) WHERE ts < last),
f AS (SELECT series_id, event_id, make_timestamp(g + floor((epoch_us(ts) - g) / 60000000)::BIGINT * 60000000) AS ts FROM e JOIN m USING (series_id))
SELECT f.series_id, f.event_id, k.value AS aligned FROM f ASOF LEFT JOIN k ON f.series_id = k.series_id AND f.ts >= k.ts + INTERVAL 1 MINUTE""",
)
def asof_align_strict(spark, d):
    return bars.align(_ticks(spark, d), _days(spark, d), "1min", strict_tail=True).select(SERIES, "event_id", "aligned")


# cleaning


@query("tz_convert", "SELECT event_id, ts + INTERVAL 330 MINUTE AS ts FROM events")
def tz_convert(spark, d):
    return cleaning.convert_zone(_ticks(spark, d), "UTC", "+05:30").select("event_id", "ts")


@query(
    "round_keep_last",
    f"""WITH q AS (SELECT *, floor(epoch_us(ts) / {HOUR})::BIGINT AS k FROM events), z AS (SELECT *, epoch_us(ts) - k * {HOUR} AS rest FROM q)
SELECT event_type AS series_id, make_timestamp((k + CASE WHEN rest * 2 > {HOUR} OR (rest * 2 = {HOUR} AND k % 2 = 1) THEN 1 ELSE 0 END) * {HOUR}) AS ts,
  arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM z GROUP BY 1, 2""",
)
def round_keep_last(spark, d):
    return cleaning.round_keep_last(_ticks(spark, d), "1h", "event_id").select(SERIES, "ts", "event_id", "value")


@query("date_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def date_range(spark, d):
    return cleaning.date_range(_ticks(spark, d), "2024-01-05", "2024-01-20").select("event_id", "ts")


@query(
    "winsorize",
    f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.15) AS a, quantile_cont(value, 0.85) AS b FROM events GROUP BY 1)
SELECT event_id, {s6("least(greatest(value, a - (b - a) * 1.5), b + (b - a) * 1.5)")} AS value FROM events JOIN q USING (event_type)""",
)
def winsorize(spark, d):
    return cleaning.winsorize(_ticks(spark, d), "value").select("event_id", r6(F.col("value")).alias("value"))


@query(
    "true_range_volume",
    f"WITH {BAR_SQL} SELECT series_id, pos, CASE WHEN pos > 0 THEN {s6('greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))')} END AS volume FROM h WINDOW w AS (PARTITION BY series_id ORDER BY pos)",
)
def true_range_volume(spark, d):
    silent = number_rows(_hours(spark, d)).withColumn("volume", F.lit(0.0))
    return cleaning.volume_proxy(silent).select(SERIES, "pos", r6(F.col("volume")).alias("volume"))


@query("asinh_scale", f"WITH m AS (SELECT event_type, min(asinh(value)) AS a, max(asinh(value)) AS b FROM events GROUP BY 1) SELECT event_id, CASE WHEN a = b THEN 0.0 ELSE {s6('(asinh(value) - a) / (b - a)')} END AS scaled FROM events JOIN m USING (event_type)")
def asinh_scale(spark, d):
    return cleaning.asinh_scale(_ticks(spark, d), "value").select("event_id", r6(F.col("scaled")).alias("scaled"))


@query("asinh_scale_raw", f"WITH m AS (SELECT event_type, min(value) AS a, max(value) AS b FROM events GROUP BY 1) SELECT event_id, CASE WHEN a = b THEN 0.0 ELSE {s6('(asinh(value) - a) / (b - a)')} END AS scaled FROM events JOIN m USING (event_type)")
def asinh_scale_raw(spark, d):
    return cleaning.asinh_scale(_ticks(spark, d), "value", domain="raw").select("event_id", r6(F.col("scaled")).alias("scaled"))


@query("drop_incomplete", f"WITH {BAR_SQL} SELECT series_id, pos, close FROM h WHERE volume > 1")
def drop_incomplete(spark, d):
    holes = number_rows(_hours(spark, d)).withColumn("open", F.when(F.col("volume") > 1, F.col("open")))
    return cleaning.drop_incomplete(holes).select(SERIES, "pos", "close")


# windows


@query("diff_returns", f"WITH {E_SQL} SELECT series_id, pos, {s6('coalesce(value - lag(value) OVER (PARTITION BY series_id ORDER BY pos), 0)')} AS diff FROM e")
def diff_returns(spark, d):
    return windows.difference(_events(spark, d)).select(SERIES, "pos", r6(F.col("diff")).alias("diff"))


@query("equity_curve", f"WITH {R_SQL} SELECT series_id, pos, {s6('sum(returns) OVER (PARTITION BY series_id ORDER BY pos)')} AS equity FROM r")
def equity_curve(spark, d):
    return windows.cumulative(_returns(spark, d)).select(SERIES, "pos", r6(F.col("equity")).alias("equity"))


@query("drawdown_additive", f"WITH {R_SQL}, c AS (SELECT series_id, pos, sum(returns) OVER (PARTITION BY series_id ORDER BY pos) AS q FROM r) SELECT series_id, pos, {s6('q - max(q) OVER (PARTITION BY series_id ORDER BY pos)')} AS drawdown FROM c")
def drawdown_additive(spark, d):
    return windows.drawdown(_returns(spark, d)).select(SERIES, "pos", r6(F.col("drawdown")).alias("drawdown"))


@query(
    "rolling_metrics",
    f"""WITH {R_SQL} SELECT series_id, pos, CASE WHEN pos >= 251 THEN {s6("avg(returns) OVER w / nullif(stddev_samp(returns) OVER w, 0) * sqrt(252)")} END AS rolling_sharpe,
  CASE WHEN pos >= 251 THEN {s6("stddev_samp(returns) OVER w * sqrt(252)")} END AS rolling_vol, CASE WHEN pos >= 251 THEN {s6("avg(returns) OVER w * 252")} END AS rolling_return
FROM r WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""",
)
def rolling_metrics(spark, d):
    out = windows.rolling(_returns(spark, d))
    return out.select(SERIES, "pos", *[r6(F.col(c)).alias(c) for c in ("rolling_sharpe", "rolling_vol", "rolling_return")])


_ALL_OF_WINDOW = (
    f"WITH {E_SQL} SELECT series_id, pos, i, x, target FROM (SELECT series_id, pos, value, lag(value, 24 - k) OVER (PARTITION BY series_id, k ORDER BY pos) AS x, k AS i, lead(value) OVER (PARTITION BY series_id, k ORDER BY pos) AS target FROM e, (SELECT unnest(range(0, 25)) AS k) t) WHERE pos >= 24"
)


@query("sliding_windows", _ALL_OF_WINDOW)
@query("sliding_windows_whole", _ALL_OF_WINDOW)
def sliding_windows(spark, d):
    w = windows.sliding(_events(spark, d), 25, target=True)
    return w.select(SERIES, "pos", "target", F.posexplode("window").alias("i", "x"))


@query("train_test_split", f"WITH {E_SQL}, n AS (SELECT series_id, count(*) AS n FROM e GROUP BY 1) SELECT series_id, pos, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM e JOIN n USING (series_id)")
def train_test_split(spark, d):
    return windows.split(_events(spark, d)).select(SERIES, "pos", "part")


@query(
    "cv_folds",
    f"""WITH {E_SQL}, n AS (SELECT series_id, count(*) AS n, floor(count(*) / 6)::BIGINT AS t FROM e GROUP BY 1), f AS (SELECT range AS fold FROM range(0, 5))
SELECT series_id, fold, part, count(*) AS n, min(pos) AS first, max(pos) AS last FROM (
  SELECT series_id, fold, pos, CASE WHEN pos < n - (5 - fold) * t THEN 'train' WHEN pos < n - (5 - fold) * t + t THEN 'test' END AS part FROM e JOIN n USING (series_id), f)
WHERE part IS NOT NULL GROUP BY ALL""",
)
def cv_folds(spark, d):
    return windows.folds(_events(spark, d)).groupBy(SERIES, "fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query(
    "moving_trend",
    f"""WITH {W_SQL}, s AS (SELECT series_id, pos, x, list_aggregate(x, 'stddev_pop') AS sd, unnest(range(0, {LENGTH})) AS i FROM w)
SELECT series_id, pos, i, {s6("least(greatest((x[i + 1] - list_aggregate(x[greatest(i - 2, 0) + 1:greatest(i - 2, 0) + 3], 'avg')) / (sd + 1e-10), -1), 1)")} AS x FROM s""",
)
def moving_trend(spark, d):
    return _each(_windows(spark, d).withColumn("t", windows.trend(F.col("window"), 3)), "t", SERIES, "pos")


# features and reducers


@query("row_zscore", f"SELECT vec_id, i, {s6('(embedding[i + 1]::DOUBLE - m) / (s + 1e-10)')} AS x FROM (SELECT vec_id, embedding, list_aggregate(embedding::DOUBLE[], 'avg') AS m, list_aggregate(embedding::DOUBLE[], 'stddev_pop') AS s, unnest(range(0, len(embedding)))::INT AS i FROM embeddings)")
def row_zscore(spark, d):
    return _each(features.zscore_rows(_vectors(spark, d)), "features", "vec_id")


@query("dedup_consecutive", f"WITH {E_SQL}, q AS (SELECT series_id, pos, floor(value / 100) AS v FROM e), k AS (SELECT series_id, pos, lag(v, 3) OVER w AS a, lag(v, 2) OVER w AS b, lag(v) OVER w AS c FROM q WINDOW w AS (PARTITION BY series_id ORDER BY pos)) SELECT series_id, pos FROM k WHERE pos >= 3 AND NOT (pos > 3 AND b = a AND c = b)")
def dedup_consecutive(spark, d):
    rough = _events(spark, d).withColumn("value", F.floor(F.col("value") / 100).cast("double"))
    w = windows.sliding(rough, 4).withColumnRenamed("window", "features")
    return features.drop_repeats(w, 4).select(SERIES, "pos")


_DFT = f"""m AS (SELECT series_id, pos, k, sqrt(pow(sum(x[t + 1] * cos(-2 * pi() * k * t / {LENGTH})), 2) + pow(sum(x[t + 1] * sin(-2 * pi() * k * t / {LENGTH})), 2)) AS v
  FROM w, range(0, {LENGTH}) a(k), range(0, {LENGTH}) b(t) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY series_id, pos ORDER BY round(v, 9) DESC, k) AS best FROM m)"""


@query("fft_topn", f"WITH {W_SQL}, {_DFT} SELECT series_id, pos, (row_number() OVER (PARTITION BY series_id, pos ORDER BY k) - 1)::INT AS i, {s6('v')} AS x FROM f WHERE best <= 4")
def fft_topn(spark, d):
    return _each(_windows(spark, d).withColumn("f", reducers.fft(F.col("window"), 4)), "f", SERIES, "pos")


_HAAR = """c AS (SELECT series_id, pos, [(x[1]+x[2]+x[3]+x[4]+x[5]+x[6]+x[7]+x[8])/sqrt(8), (x[1]+x[2]+x[3]+x[4]-x[5]-x[6]-x[7]-x[8])/sqrt(8), (x[1]+x[2]-x[3]-x[4])/2, (x[5]+x[6]-x[7]-x[8])/2,
  (x[1]-x[2])/sqrt(2), (x[3]-x[4])/sqrt(2), (x[5]-x[6])/sqrt(2), (x[7]-x[8])/sqrt(2)] AS v FROM w),
u AS (SELECT series_id, pos, unnest(range(1, 9)) AS k, unnest(v) AS v FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY series_id, pos ORDER BY round(abs(v), 9) DESC, k) AS best FROM u)"""


@query("haar_topn", f"WITH {W_SQL}, {_HAAR} SELECT series_id, pos, (row_number() OVER (PARTITION BY series_id, pos ORDER BY k) - 1)::INT AS i, {s6('v')} AS x FROM t WHERE best <= 4")
def haar_topn(spark, d):
    return _each(_windows(spark, d).withColumn("f", reducers.wavelet(F.col("window"), 4, "haar")), "f", SERIES, "pos")


@query("fft_wavelet", f"WITH {W_SQL}, {_DFT}, {_HAAR} SELECT series_id, pos, (row_number() OVER (PARTITION BY series_id, pos ORDER BY k) - 1)::INT AS i, {s6('v')} AS x FROM f WHERE best <= 2 UNION ALL SELECT series_id, pos, (row_number() OVER (PARTITION BY series_id, pos ORDER BY k) + 1)::INT, {s6('v')} FROM t WHERE best <= 2")
def fft_wavelet(spark, d):
    return _each(_windows(spark, d).withColumn("f", reducers.fft_wavelet(F.col("window"), 4)), "f", SERIES, "pos")


@query(
    "pip_three_points",
    f"""WITH {W_SQL}, o AS (SELECT series_id, pos, x, i, abs(x[1] + (x[{LENGTH}] - x[1]) / {LENGTH - 1} * i - x[i + 1]) AS off FROM (SELECT series_id, pos, x, unnest(range(1, {LENGTH - 1})) AS i FROM w)),
p AS (SELECT series_id, pos, any_value(x) AS x, arg_max(i, (round(off, 12), -i)) AS best FROM o GROUP BY 1, 2)
SELECT series_id, pos, unnest([0, 1, 2]) AS i, unnest([{s6("x[1]")}, {s6("x[best + 1]")}, {s6(f"x[{LENGTH}]")}]) AS x FROM p""",
)
def pip_three_points(spark, d):
    return _each(_windows(spark, d).withColumn("f", reducers.pip(F.col("window"), 3, reducers.DistanceMeasure.VERTICAL)), "f", SERIES, "pos")


W25_SQL = W_SQL.replace(f"{LENGTH - 1} PRECEDING", "24 PRECEDING").replace(f"len(x) = {LENGTH}", "len(x) = 25")


def _pip_sql(n: int, size: int) -> str:
    """p{n - 2}: pts, n places (from 0) of important points of w.x, by the sum of distances to both neighbours chosen."""
    out = [f"p0 AS (SELECT series_id, pos, x, [0, {size - 1}]::BIGINT[] AS pts FROM w)"]
    for k in range(n - 2):
        near = f"SELECT *, list_max(list_filter(pts, lambda q: q < i)) AS a, list_min(list_filter(pts, lambda q: q > i)) AS b FROM (SELECT *, unnest(range(1, {size - 1})) AS i FROM p{k}) WHERE NOT list_contains(pts, i)"
        far = "round(sqrt(pow(a - i, 2) + pow(x[a + 1] - x[i + 1], 2)) + sqrt(pow(b - i, 2) + pow(x[b + 1] - x[i + 1], 2)), 12)"
        out.append(f"p{k + 1} AS (SELECT series_id, pos, any_value(x) AS x, list_sort(list_append(any_value(pts), arg_max(i, ({far}, -i)))) AS pts FROM ({near}) GROUP BY 1, 2)")
    return ", ".join(out)


@query("pip_reduce", f"WITH {W25_SQL}, {_pip_sql(5, 25)} SELECT series_id, pos, i, {s6('x[pts[i + 1] + 1]')} AS x FROM (SELECT *, unnest(range(0, 5))::INT AS i FROM p3)")
def pip_reduce(spark, d):
    return _each(_windows(spark, d, 25).withColumn("f", reducers.pip(F.col("window"), 5)), "f", SERIES, "pos")


def _wavelet_sql(name: str, size: int, top: int, f: str = "u") -> str:
    """t: the coefficients v at places k of w.x, ranked by size (best); each level written out as sums over borders mirrored."""
    rec = kernels.FILTERS[name]
    low, high = rec[::-1], [(-1) ** (k + 1) * c for k, c in enumerate(rec)]
    width, n, level, source, details = len(rec), size, 0, "x", []
    ctes = ["c0 AS (SELECT series_id, pos, x FROM w)"]
    while n >= width - 1 and (size // (width - 1)) >> (level + 1):
        def at(i: int, n: int = n) -> int:
            i %= 2 * n
            return (i if i < n else 2 * n - 1 - i) + 1
        half = (n + width - 1) // 2
        taps = lambda filt: "[" + ", ".join(" + ".join(f"({c!r}::DOUBLE) * {source}[{at(2 * k + 1 - j)}]" for j, c in enumerate(filt)) for k in range(half)) + "]"  # noqa: B023, E731
        level += 1
        ctes.append(f"c{level} AS (SELECT *, {taps(low)} AS a{level}, {taps(high)} AS d{level} FROM c{level - 1})")
        details.insert(0, f"d{level}")
        n, source = half, f"a{level}"
    every = " || ".join([source, *details])
    ctes.append(f"u AS (SELECT series_id, pos, unnest(v) AS v, unnest(range(0, len(v))) AS k FROM (SELECT series_id, pos, {every} AS v FROM c{level}))")
    ctes.append("t AS (SELECT *, row_number() OVER (PARTITION BY series_id, pos ORDER BY round(abs(v), 9) DESC, k) AS best FROM u)")
    return ", ".join(ctes) + f" SELECT series_id, pos, (row_number() OVER (PARTITION BY series_id, pos ORDER BY k) - 1)::INT AS i, {s6('v')} AS x FROM t WHERE best <= {top}"


@query("wavelet_reduce", f"WITH {W25_SQL}, {_wavelet_sql('coif1', 25, 4)}")
def wavelet_reduce(spark, d):
    return _each(_windows(spark, d, 25).withColumn("f", reducers.wavelet(F.col("window"), 4, "coif1")), "f", SERIES, "pos")


@query("wavelet_db2", f"WITH {W25_SQL}, {_wavelet_sql('db2', 25, 4)}")
def wavelet_db2(spark, d):
    return _each(_windows(spark, d, 25).withColumn("f", reducers.wavelet(F.col("window"), 4, "db2")), "f", SERIES, "pos")


@query("wavelet_sym5", f"WITH {W25_SQL}, {_wavelet_sql('sym5', 25, 4)}")
def wavelet_sym5(spark, d):
    return _each(_windows(spark, d, 25).withColumn("f", reducers.wavelet(F.col("window"), 4, "sym5")), "f", SERIES, "pos")


def _pivot_sql(n: int, size: int) -> str:
    """Windows w of e and their pivots: z has p, the places, after up to n - 2 steps; y has their segments j from s to t."""
    left, right = "list_max(list_filter(p, lambda q: q < i))", "list_min(list_filter(p, lambda q: q > i))"
    chord = f"x[{left} + 1] + (x[{right} + 1] - x[{left} + 1]) * (i - {left}) / ({right} - {left})::DOUBLE"
    off = f"CASE WHEN list_contains(p, i) OR abs(x[{right} + 1] - x[{left} + 1]) < span * 0.001::DOUBLE THEN 0 ELSE round(abs({chord} - x[i + 1]) / span, 9) END"
    return f"""w AS (SELECT series_id, pos, x, list_max(x) - list_min(x) AS span FROM (SELECT series_id, pos, list(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS x FROM e) WHERE len(x) = {size}),
g AS (SELECT series_id, pos, x, span, [0, {size - 1}]::BIGINT[] AS p, 2 AS k FROM w
  UNION ALL SELECT series_id, pos, x, span, list_sort(list_append(p, -best.i)), k + 1 FROM (SELECT *, list_max(list_transform(range(1, {size - 1}), lambda i: struct_pack(d := {off}, i := -i))) AS best FROM g WHERE k < {n} AND span > 0) WHERE best.d > 0),
z AS (SELECT series_id, pos, any_value(x) AS x, arg_max(p, k) AS p FROM g GROUP BY 1, 2),
y AS (SELECT series_id, pos, x, j, p[j] AS s, p[j + 1] AS t, x[p[j + 1] + 1] - x[p[j] + 1] AS rise, (p[j + 1] - p[j])::DOUBLE AS run, len(p) - 1 AS m FROM (SELECT *, unnest(range(1, len(p))) AS j FROM z))"""


_WILD = "list_aggregate(list_transform(range(s, t), lambda q: x[q + 2] - x[q + 1]), 'stddev_pop')"
_MOVEMENT_SQL = f"""WITH RECURSIVE {E_SQL}, {_pivot_sql(4, 10)},
f AS (SELECT series_id, pos, j, [rise, run, atan2(rise, run) / pi(), rise / run, coalesce(rise / run - lag(rise / run) OVER o, 0), rise / (avg(abs(rise)) OVER (PARTITION BY series_id, pos) + 1e-10), {_WILD},
  list_sum(list_transform(range(s, t + 1), lambda q: (q - (s + t) / 2.0::DOUBLE) * x[q + 1])) / ((run + 1) * ((run + 1) * (run + 1) - 1) / 12)] AS f FROM y WINDOW o AS (PARTITION BY series_id, pos ORDER BY j)),
v AS (SELECT series_id, pos, 8 * (j - 1) + unnest(range(0, 8)) AS i, unnest(f) AS x FROM f)
SELECT w.series_id, w.pos, k::INT AS i, {s6("coalesce(v.x, 0)")} AS x FROM w CROSS JOIN range(0, 24) r(k) LEFT JOIN v ON v.series_id = w.series_id AND v.pos = w.pos AND v.i = k"""
_MEAN7 = "list_avg(x[greatest(q - 6, 0) + 1 : greatest(q - 6, 0) + 7])"
_MVR_SQL = f"""WITH RECURSIVE {E_SQL}, {_pivot_sql(3, 25)},
h AS (SELECT series_id, pos, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS r, coalesce(flatten(list(x) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)), x) AS h FROM w),
d AS (SELECT series_id, pos, r, h, list_transform(range(1, len(h)), lambda q: h[q + 1] - h[q]) AS d FROM h),
c AS (SELECT series_id, pos, r, h[greatest(len(h) - 99, 1) :] AS h, d, CASE WHEN len(d) > least(100, len(h)) THEN d[len(d) - least(100, len(h)) + 2 :] ELSE d END AS c FROM d),
n AS (SELECT series_id, pos, r, list_aggregate(d, 'stddev_pop') + 1e-10 AS s1, list_avg(h) AS s2, list_aggregate(list_transform(range(1, len(c) + 1), lambda q: c[q] / q), 'stddev_pop') + 1e-10 AS s3,
  list_avg(list_transform(c, lambda v: abs(v))) / ((len(c) + 1) / 2.0::DOUBLE) AS s4, list_aggregate(list_transform(c, lambda v: abs(v)), 'stddev_pop') + 1e-10 AS s5 FROM c),
a AS (SELECT t.series_id, t.pos, any_value(t.r) AS r, {", ".join(f"sum(0.1::DOUBLE * pow(0.9::DOUBLE, t.r - b.r) * b.s{k}) + any_value(pow(0.9::DOUBLE, t.r + 1) * {k % 2}) AS s{k}" for k in range(1, 6))}
  FROM n t JOIN n b ON b.series_id = t.series_id AND b.r <= t.r AND b.r > t.r - 400 GROUP BY t.series_id, t.pos),
l AS (SELECT series_id, pos, lag(rise / run) OVER o AS before, avg(abs(rise)) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS scale FROM y WHERE j = m WINDOW o AS (PARTITION BY series_id ORDER BY pos)),
f AS (SELECT y.series_id, y.pos, j, [(rise - s2) / s1, run, atan2(rise, run) / pi(), (rise / run - s4) / s3, rise / run - coalesce(lag(rise / run) OVER o, before, rise / run), CASE WHEN scale IS NULL THEN 1 ELSE rise / (scale + 1e-10) END, {_WILD} / s5,
  list_avg(list_transform(range(s, t + 1), lambda q: least(greatest((x[q + 1] - {_MEAN7}) / (list_aggregate(x, 'stddev_pop') + 1e-10), -1), 1)))] AS f
  FROM y JOIN a USING (series_id, pos) JOIN l USING (series_id, pos) WINDOW o AS (PARTITION BY y.series_id, y.pos ORDER BY j)),
v AS (SELECT series_id, pos, 8 * (j - 1) + unnest(range(0, 8)) AS i, unnest(f) AS x FROM f)
SELECT w.series_id, w.pos, k::INT AS i, {s6("coalesce(v.x, 0)")} AS x FROM w CROSS JOIN range(0, 16) r(k) LEFT JOIN v ON v.series_id = w.series_id AND v.pos = w.pos AND v.i = k"""


@query("mvr_reduce", _MVR_SQL)
def mvr_reduce(spark, d):
    return _each(reducers.movement_vectors(_windows(spark, d, 25), 16, trend_window=7), "features", SERIES, "pos")


@query("movement_features", _MOVEMENT_SQL)
def movement_features(spark, d):
    m = _windows(spark, d, 10).withColumn("m", reducers.movement_features(F.col("window"), 4))
    return _each(m.select(SERIES, "pos", reducers.pack(F.col("m"), 24).alias("m")), "m", SERIES, "pos")


@query("pack_vectors", f"SELECT vec_id, i, {s6('CASE WHEN i < 24 THEN embedding[9 + i]::DOUBLE ELSE 0 END')} AS x FROM (SELECT vec_id, embedding, unnest(range(0, 30))::INT AS i FROM embeddings)")
def pack_vectors(spark, d):
    return _each(_samples(spark, d).withColumn("m", reducers.pack(F.col("future"), 30)), "m", "vec_id")


@query("movement_importance", f"WITH v AS (SELECT i, var_pop(x) AS v FROM (SELECT unnest(embedding[1:8]::DOUBLE[]) AS x, unnest(range(0, 8)) AS i FROM embeddings) GROUP BY 1) SELECT list_extract({list(MOVEMENT)}, (i + 1)::INT) AS feature, {s6('v / sum(v) OVER ()')} AS importance FROM v")
def movement_importance(spark, d):
    return reducers.movement_importance(_samples(spark, d), "features").select("feature", r6(F.col("importance")).alias("importance"))


# distances and clusters

_V_SQL = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT vec_id::INT AS cluster, x AS center FROM v WHERE vec_id < 4), d AS (SELECT v.vec_id, label, x, cluster, list_distance(x, center) AS dist FROM v, c)"
_N_SQL = _V_SQL + ", n AS (SELECT vec_id, label, any_value(x) AS x, arg_min(cluster, (dist, cluster)) AS cluster, min(dist) AS distance FROM d GROUP BY 1, 2)"


@query("l2_distance", f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT a.vec_id, {s6('list_distance(a.x, b.x)')} AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def l2_distance(spark, d):
    v = _vectors(spark, d)
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("features").alias("b"))
    return v.join(after, "vec_id").select("vec_id", r6(distance.l2(F.col("features"), F.col("b"))).alias("distance"))


@query("nearest_center", f"WITH {_N_SQL} SELECT vec_id, cluster, {s6('distance')} AS distance FROM n")
def nearest_center(spark, d):
    return cluster.assign(_vectors(spark, d), _centers(spark, d)).select("vec_id", "cluster", r6(F.col("distance")).alias("distance"))


@query("lloyd_step", f"WITH {_N_SQL} SELECT cluster, i, {s6('avg(x[i + 1])')} AS x FROM (SELECT cluster, x, unnest(range(0, len(x)))::INT AS i FROM n) GROUP BY 1, 2")
def lloyd_step(spark, d):
    return _each(cluster.update_centers(cluster.assign(_vectors(spark, d), _centers(spark, d))), "center", "cluster")


@query("softmax_probs", f"WITH {_V_SQL} SELECT vec_id, cluster AS i, {s6('exp(min(dist) OVER w - dist) / sum(exp(m - dist)) OVER w')} AS x FROM (SELECT *, min(dist) OVER (PARTITION BY vec_id) AS m FROM d) WINDOW w AS (PARTITION BY vec_id)")
def softmax_probs(spark, d):
    return _each(_vectors(spark, d).withColumn("p", cluster.probabilities(cluster.distances(F.col("features"), _centers(spark, d)))), "p", "vec_id")


@query(
    "signal_decision",
    f"""WITH {_V_SQL}, p AS (SELECT vec_id, cluster, exp(min(dist) OVER w - dist) AS e FROM d WINDOW w AS (PARTITION BY vec_id)),
s AS (SELECT vec_id, sum(e) FILTER (cluster IN (0, 1)) / sum(e) AS up, sum(e) FILTER (cluster = 2) / sum(e) AS down FROM p GROUP BY 1)
SELECT vec_id, CASE WHEN up > 0.6 AND up > down THEN 1 WHEN down > 0.6 AND down > up THEN -1 ELSE 0 END AS signal,
  round(CASE WHEN up > 0.6 AND up > down THEN up WHEN down > 0.6 AND down > up THEN down ELSE greatest(1 - (up + down), 0) END, 6) + 0.0 AS confidence FROM s""",
)
def signal_decision(spark, d):
    out = cluster.signals(_vectors(spark, d), _centers(spark, d), [0, 1], [2])
    return out.select("vec_id", "signal", r6(F.col("confidence")).alias("confidence"))


@query("kmeans_fit")
def kmeans_fit(spark, d):
    return cluster.assign(_vectors(spark, d), cluster.fit_kmeans(_vectors(spark, d), 8)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("distance")).alias("distance"))


def _lloyd_sql(steps: int) -> str:
    """n: each vector's nearest center after so many steps from the vectors 0 to 3, an empty cluster keeping its center."""
    out = ["v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)", "c0 AS (SELECT vec_id::INT AS cluster, x AS center FROM v WHERE vec_id < 4)"]
    near = "SELECT vec_id, any_value(x) AS x, arg_min(cluster, (dist, cluster)) AS cluster, min(dist) AS distance FROM (SELECT vec_id, x, cluster, list_distance(x, center) AS dist FROM v, c{}) GROUP BY 1"
    for k in range(steps):
        mean = f"SELECT cluster, list(m ORDER BY i) AS center FROM (SELECT cluster, i, avg(e) AS m FROM (SELECT cluster, unnest(x) AS e, unnest(range(0, len(x))) AS i FROM ({near.format(k)})) GROUP BY 1, 2) GROUP BY 1"
        out.append(f"c{k + 1} AS (SELECT c{k}.cluster, coalesce(m.center, c{k}.center) AS center FROM c{k} LEFT JOIN ({mean}) m USING (cluster))")
    return ", ".join([*out, f"n AS ({near.format(steps)})"])


@query("lloyd_fit", f"WITH {_lloyd_sql(3)} SELECT cluster, count(*) AS n, {s6('avg(distance)')} AS distance FROM n GROUP BY 1")
def lloyd_fit(spark, d):
    v = _vectors(spark, d)
    centers = cluster.fit_sequential(v, 4, max_iter=3, start=_centers(spark, d))
    return cluster.assign(v, centers).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("distance")).alias("distance"))


@query("sequential_kmeans")
def sequential_kmeans(spark, d):
    centers = cluster.fit_sequential(_vectors(spark, d), 4, max_iter=10)
    return cluster.assign(_vectors(spark, d), centers).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("distance")).alias("distance"))


def _dtw_sql(n: int) -> str:
    """The cells of the warping table of x and y, n values each, one diagonal after another."""
    rows = "b WHERE y IS NOT NULL"
    for d in range(2, 2 * n + 1):
        cells = []
        for i in range(max(1, d - n), min(n, d - 1) + 1):
            j = d - i
            before = [f"g{a}_{b}" for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a and b]
            cells.append(f"pow(x[{i}] - y[{j}], 2)" + (f" + least({', '.join(before)})" if before else "") + f" AS g{i}_{j}")
        rows = f"(SELECT *, {', '.join(cells)} FROM {rows})"
    return rows


@query("dtw_distance", f"WITH {W_SQL}, b AS (SELECT series_id, pos, x, lag(x, {LENGTH}) OVER (PARTITION BY series_id ORDER BY pos) AS y FROM w) SELECT series_id, pos, {s6(f'sqrt(g{LENGTH}_{LENGTH})')} AS distance FROM {_dtw_sql(LENGTH)}")
def dtw_distance(spark, d):
    w = _windows(spark, d)
    pairs = framed(w, {"before": lambda o: F.lag("window", LENGTH).over(o)}, before=LENGTH).where("before is not null")
    return pairs.select(SERIES, "pos", r6(distance.dtw(F.col("window"), F.col("before"))).alias("distance"))


_MP_SQL = """WITH s AS (SELECT vec_id, i, (embedding::DOUBLE[])[i + 1:i + 16] AS x FROM embeddings, range(0, 49) t(i)),
m AS (SELECT a.vec_id, a.i, min(list_distance(a.x, b.x)) AS d FROM s a JOIN s b ON a.vec_id = b.vec_id AND abs(a.i - b.i) >= 16 GROUP BY 1, 2)
SELECT a.vec_id, round(avg(abs(a.d - b.d)), 5) + 0.0 AS distance FROM m a JOIN m b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1"""


@query("mpdist_distance", _MP_SQL)
def mpdist_distance(spark, d):
    return _mpdist(spark, d, "brute")


@query("mpdist_sliding", _MP_SQL)
def mpdist_sliding(spark, d):
    """The same by sliding products."""
    return _mpdist(spark, d, "sliding")


def _mpdist(spark: SparkSession, d: str, how: str) -> DataFrame:
    v = _vectors(spark, d)
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("features").alias("b"))
    return v.join(after, "vec_id").select("vec_id", (F.round(distance.mpdist(F.col("features"), F.col("b"), how=how), 5) + F.lit(0.0)).alias("distance"))


# holding and evaluation

def _hold_sql(source: str, hold: int) -> str:
    """acc: the positions that source (series_id, cluster, pos) takes, each with all of hold positions held."""
    return f"""s AS (SELECT DISTINCT series_id, cluster, pos FROM {source}),
nx AS (SELECT *, min(pos) OVER (PARTITION BY series_id, cluster ORDER BY pos RANGE BETWEEN {hold + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s),
acc AS (SELECT series_id, cluster, min(pos) AS pos FROM s GROUP BY 1, 2 UNION ALL SELECT acc.series_id, acc.cluster, nx.nxt FROM acc JOIN nx USING (series_id, cluster, pos) WHERE nx.nxt IS NOT NULL),
hp AS (SELECT series_id, cluster, entry, entry + k AS pos FROM (SELECT series_id, cluster, pos AS entry, unnest(range(1, {hold} + 1)) AS k FROM acc))"""


H_SQL = "RECURSIVE " + L_SQL + ", " + _hold_sql("l", 6)


@query("holding_period", f"WITH {H_SQL} SELECT series_id, cluster::INT AS cluster, pos FROM acc")
def holding_period(spark, d):
    return hold.accept(_labels(spark, d), 6, (SERIES, "cluster"))


def _metric_sql(by: str, source: str, order: str) -> str:
    """All metrics of (by, returns) in the given order."""
    return f"""x AS (SELECT {by}, returns, sum(ln(greatest(1 + returns, 1e-300))) OVER (PARTITION BY {by} ORDER BY {order}) AS q, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS o FROM {source}),
y AS (SELECT *, exp(q - greatest(0, max(q) OVER (PARTITION BY {by} ORDER BY o))) - 1 AS dd FROM x),
z AS (SELECT {by}, sum(returns) AS total_return, avg(returns) * 252 AS annual_return, stddev_pop(returns) * sqrt(252) AS volatility, avg(returns) / nullif(stddev_samp(returns), 0) * sqrt(252) AS sharpe,
  avg(returns) / nullif(sqrt(sum(CASE WHEN returns < 0 THEN returns * returns ELSE 0 END) / count(*)), 0) * sqrt(252) AS sortino,
  abs(sum(CASE WHEN returns >= 0 THEN returns ELSE 0 END) / nullif(sum(CASE WHEN returns < 0 THEN returns ELSE 0 END), 0)) AS profit_factor,
  count(*) FILTER (returns > 0) / nullif(count(*) FILTER (returns <> 0), 0)::DOUBLE AS win_rate, avg(returns) FILTER (returns <> 0) AS avg_return, avg(returns) FILTER (returns > 0) AS avg_win,
  avg(returns) FILTER (returns < 0) AS avg_loss, count(*) AS n, exp(sum(ln(greatest(1 + returns, 1e-300)))) - 1 AS compounded, sqrt(sum(dd * dd) / nullif(count(*) - 1, 0)) AS ulcer,
  min(dd) AS max_drawdown, avg(dd) AS mean_drawdown FROM y GROUP BY {by})"""


_SHOWN = ("total_return", "annual_return", "volatility", "sharpe", "sortino", "profit_factor", "win_rate", "avg_return", "avg_win", "avg_loss", "compounded", "ulcer", "max_drawdown", "mean_drawdown")
_SHOWN_SQL = ", ".join(f"{s6(c)} AS {c}" for c in _SHOWN) + f", n, {s6('pow((1 - win_rate) / (1 + win_rate), n)')} AS risk_of_ruin, {s6('compounded / nullif(ulcer, 0)')} AS martin"


def _shown(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, *[r6(F.col(c)).alias(c) for c in (*_SHOWN, "risk_of_ruin", "martin")], "n")


@query("perf_report", f"WITH {R_SQL}, {_metric_sql('series_id', 'r', 'pos')} SELECT series_id, {_SHOWN_SQL} FROM z")
def perf_report(spark, d):
    return _shown(metrics.performance(_returns(spark, d), [SERIES]), SERIES)


_HOLD_METRICS = f"{H_SQL}, side AS (SELECT unnest([1, -1]) AS side), g AS (SELECT hp.series_id, hp.cluster, side, hp.pos, r.returns * side AS returns FROM hp JOIN r USING (series_id, pos), side), {_metric_sql('cluster, side', 'g', 'series_id, pos')}"


@query("holding_metrics", f"WITH {_HOLD_METRICS} SELECT cluster::INT AS cluster, side, {_SHOWN_SQL} FROM z")
def holding_metrics(spark, d):
    l = _labels(spark, d)
    return _shown(evaluate.holding_metrics(l, l, 6, 1), "cluster", "side")


def _drifting(labels: DataFrame) -> DataFrame:
    """labels with small returns and a drift, so that clusters are worth trading."""
    return labels.withColumn("returns", F.col("returns") / 1000 + 0.0002)


_DRIFT_METRICS = _HOLD_METRICS.replace("r.returns * side AS returns", "(r.returns / 1000 + 0.0002::DOUBLE) * side AS returns")


@query(
    "cluster_selection",
    f"""WITH {_DRIFT_METRICS}, m AS (SELECT *, compounded / nullif(ulcer, 0) AS martin FROM z), b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(martin, '-infinity'::DOUBLE) DESC, side) AS k FROM m),
t AS (SELECT cluster, side, avg_return, martin, 0.4 * coalesce(martin, 0) + 0.3 * coalesce(sharpe, 0) + 0.2 * coalesce(profit_factor, 0) + 0.1 * coalesce(win_rate, 0) AS score FROM b WHERE k = 1)
SELECT cluster::INT AS cluster, side, {s6("score")} AS score FROM t WHERE abs(score) > 0.1 AND martin > 0 AND avg_return > 0""",
)
def cluster_selection(spark, d):
    l = _drifting(_labels(spark, d))
    best = evaluate.better_side(evaluate.holding_metrics(l, l, 6, 1))
    return evaluate.select_clusters(best, 0.1).select("cluster", "side", r6(F.col("score")).alias("score"))


@query("compute_performance", f"WITH {L_SQL}, g AS (SELECT series_id, pos, returns * CASE WHEN cluster = 1 THEN 1 WHEN cluster = 2 THEN -1 ELSE 0 END AS returns FROM l), {_metric_sql('series_id', 'g', 'pos')} SELECT series_id, {_SHOWN_SQL} FROM z")
def compute_performance(spark, d):
    l = _labels(spark, d)
    return _shown(evaluate.strategy_performance(l.drop("returns"), l, [1], [2]), SERIES)


@query("transition_matrix", f"WITH {L_SQL}, p AS (SELECT cluster AS a, lead(cluster) OVER (PARTITION BY series_id ORDER BY pos) AS b FROM l) SELECT a::INT AS \"from\", b::INT AS \"to\", count(*) AS n, {s6('count(*) / sum(count(*)) OVER (PARTITION BY a)')} AS p FROM p WHERE b IS NOT NULL GROUP BY a, b")
def transition_matrix(spark, d):
    return evaluate.transitions(_labels(spark, d)).select("from", "to", "n", r6(F.col("p")).alias("p"))


@query("signal_distribution", f"WITH {L_SQL}, s AS (SELECT cluster, sign(returns)::INT AS g FROM l) SELECT cluster::INT AS cluster, {s6('avg((g = 1)::INT)')} AS long_share, {s6('avg((g = 0)::INT)')} AS flat_share, {s6('avg((g = -1)::INT)')} AS short_share, count(*) AS n FROM s GROUP BY 1")
def signal_distribution(spark, d):
    out = evaluate.signal_distribution(_labels(spark, d).withColumn("signal", F.signum("returns").cast("int")))
    return out.select("cluster", *[r6(F.col(c)).alias(c) for c in ("long_share", "flat_share", "short_share")], "n")


@query("cluster_pattern", f"SELECT label, i, {s6('avg(x)')} AS mean, {s6('stddev_pop(x)')} AS std FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding)))::INT AS i FROM embeddings) GROUP BY 1, 2")
def cluster_pattern(spark, d):
    return evaluate.cluster_pattern(_vectors(spark, d), by="label").select("label", "i", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("cluster_sizes", f"WITH {L_SQL} SELECT cluster::INT AS cluster, count(*) AS n FROM l GROUP BY 1")
def cluster_sizes(spark, d):
    return cleaning.check_labels(_labels(spark, d), 4, "cluster")


@query(
    "return_histogram",
    f"""WITH {R_SQL}, m AS (SELECT series_id, min(returns) AS a, max(returns) AS b FROM r GROUP BY 1), k AS (SELECT series_id, least(floor((returns - a) / ((b - a) / 20)), 19)::INT AS bin, a, b FROM r JOIN m USING (series_id))
SELECT series_id, bin, count(*) AS n, {s6("count(*) / (sum(count(*)) OVER (PARTITION BY series_id) * ((b - a) / 20))")} AS density FROM k GROUP BY series_id, bin, a, b""",
)
def return_histogram(spark, d):
    return evaluate.histogram(_returns(spark, d), "returns", 20, (SERIES,)).select(SERIES, "bin", "n", r6(F.col("density")).alias("density"))


@query(
    "moments",
    f"""WITH {R_SQL}, m AS (SELECT series_id, avg(returns) AS m, stddev_pop(returns) AS s, median(returns) AS h FROM r GROUP BY 1)
SELECT series_id, {s6("m")} AS mean, {s6("h")} AS median, {s6("s")} AS std, {s6("avg(pow((returns - m) / s, 3))")} AS skew, {s6("avg(pow((returns - m) / s, 4)) - 3")} AS kurtosis FROM r JOIN m USING (series_id) GROUP BY series_id, m, s, h""",
)
def moments(spark, d):
    aggs = metrics.moments(F.col("returns"))
    return _returns(spark, d).groupBy(SERIES).agg(*[r6(c).alias(n) for n, c in aggs.items()])


@query("information_ratio", f"WITH {R_SQL}, b AS (SELECT pos, avg(returns) AS base FROM r GROUP BY 1) SELECT series_id, {s6('avg(returns - base) / nullif(stddev_pop(returns - base), 0) * sqrt(252)')} AS ratio FROM r JOIN b USING (pos) GROUP BY 1")
def information_ratio(spark, d):
    r = _returns(spark, d)
    base = r.groupBy("pos").agg(F.avg("returns").alias("base"))
    return r.join(base, "pos").groupBy(SERIES).agg(r6(metrics.information_ratio(F.col("returns"), F.col("base"))).alias("ratio"))


@query(
    "chart_metrics",
    f"""WITH {R_SQL}, c AS (SELECT series_id, pos, returns, sum(returns) OVER (PARTITION BY series_id ORDER BY pos) AS q FROM r), f AS (SELECT *, q - max(q) OVER (PARTITION BY series_id ORDER BY pos) AS dd FROM c)
SELECT series_id, {s6("avg(returns) / nullif(stddev_pop(returns), 0) * sqrt(252)")} AS sharpe, {s6("avg(returns) * 252")} AS annual_return, {s6("min(dd)")} AS max_drawdown FROM f GROUP BY 1""",
)
def chart_metrics(spark, d):
    out = metrics.chart_metrics(windows.drawdown(_returns(spark, d)), [SERIES])
    return out.select(SERIES, *[r6(F.col(c)).alias(c) for c in ("sharpe", "annual_return", "max_drawdown")])


_PAIR = f"""a AS (SELECT series_id, pos, list(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS x FROM e),
p AS (SELECT series_id, pos, x[1:6] AS cur, x[7:12] AS fut, ((list_max(x[1:6]) - list_min(x[1:6])) + (list_max(x[7:12]) - list_min(x[7:12]))) / 2 AS m FROM a WHERE len(x) = 12),
k AS (SELECT series_id, pos FROM p WHERE m > 0 AND list_max(cur) - list_min(cur) >= m * 0.5 AND list_max(fut) - list_min(fut) >= m * 0.5
  AND list_aggregate(list_transform(range(1, 6), lambda i: cur[i + 1] - cur[i]), 'stddev_pop') <= m * 0.6 AND list_aggregate(list_transform(range(1, 6), lambda i: fut[i + 1] - fut[i]), 'stddev_pop') <= m * 0.6)"""


@query("pair_quality", f"WITH {E_SQL}, {_PAIR} SELECT series_id, pos FROM k")
def pair_quality(spark, d):
    e = _events(spark, d)
    spans = framed(e, {"x": lambda w: F.collect_list("value").over(w.rowsBetween(0, 11))}, after=11).where(F.size("x") == 12)
    return spans.where(evaluate.pair_quality(F.slice("x", 1, 6), F.slice("x", 7, 6), 0.5, 0.6)).select(SERIES, "pos")


@query("window_pairs", f"WITH RECURSIVE {L_SQL}, {_PAIR}, kl AS (SELECT series_id, cluster, pos FROM k JOIN l USING (series_id, pos)), {_hold_sql('kl', 11)} SELECT series_id, cluster::INT AS cluster, pos FROM acc")
def window_pairs(spark, d):
    return evaluate.window_pairs(_labels(spark, d), _events(spark, d), 3, 0.5, 0.6).select(SERIES, "cluster", "pos")


# scorer


def _samples(spark, d):
    """Each vector's first 8 numbers as features, the next 24 as three future vectors."""
    v = _vectors(spark, d).withColumn("change", F.col("features")[32])
    future = F.array(*[F.slice("features", 9 + 8 * i, 8) for i in range(3)])
    return v.select("vec_id", "label", future.alias("future"), F.slice("features", 1, 8).alias("features"), "change")


_T_SQL = f"""q AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT vec_id, x, x[33] AS change, (((sign(x[9]) = sign(x[33]))::INT + (sign(x[17]) = sign(x[33]))::INT + (sign(x[25]) = sign(x[33]))::INT) / 3.0::DOUBLE) AS cons, abs(x[33]) / (abs(x[9]) + abs(x[17]) + abs(x[25]) + 1e-10) AS eff FROM q),
m AS (SELECT avg(change) AS a, stddev_pop(change) AS b, avg(cons) AS c, stddev_pop(cons) AS e, avg(eff) AS f, stddev_pop(eff) AS g FROM s),
t AS (SELECT vec_id, x, 0.4 * (change - a) / (b + 1e-10) + 0.3 * (cons - c) / (e + 1e-10) + 0.3 * (eff - f) / (g + 1e-10) AS target FROM s, m)"""


@query("target_scores", f"WITH {_T_SQL} SELECT vec_id, {s6('target')} AS target FROM t")
def target_scores(spark, d):
    return scorer.target_scores(_samples(spark, d)).select("vec_id", r6(F.col("target")).alias("target"))


@query(
    "ridge_gram",
    f"WITH {_T_SQL} SELECT " + ", ".join([f"{s6(f'sum(x[{i + 1}] * x[{j + 1}])')} AS g_{i}_{j}" for i in range(8) for j in range(i, 8)] + [f"{s6(f'sum(x[{i + 1}] * target)')} AS b_{i}" for i in range(8)]) + ", count(*) AS n FROM t",
)
def ridge_gram(spark, d):
    g = scorer.gram(scorer.target_scores(_samples(spark, d)))
    return g.select(*[r6(F.col(c)).alias(c) if c != "n" else F.col(c) for c in g.columns])


@query("score_clip", f"SELECT vec_id, {s6('least(greatest((0.5 * embedding[1]::DOUBLE - 0.25 * embedding[2]::DOUBLE - 0.1) / 0.2 / 2, -1), 1)')} AS score FROM embeddings")
def score_clip(spark, d):
    raw = scorer.raw_score(F.slice("features", 1, 2), (0.5, -0.25))
    return _vectors(spark, d).select("vec_id", r6(scorer.clipped((raw - 0.1) / 0.2)).alias("score"))


_RIDGE2 = f"""{_T_SQL}, k AS (SELECT sum(x[1] * x[1]) + 0.01::DOUBLE AS a, sum(x[1] * x[2]) AS b, sum(x[2] * x[2]) + 0.01::DOUBLE AS c, sum(x[1] * target) AS p, sum(x[2] * target) AS q FROM t),
w AS (SELECT (p * c - q * b) / (a * c - b * b) AS w1, (a * q - b * p) / (a * c - b * b) AS w2 FROM k),
y AS (SELECT vec_id, w1 * x[1] + w2 * x[2] AS raw FROM t, w), z AS (SELECT avg(raw) AS m, stddev_pop(raw) AS s FROM y)"""


@query("scorer_fit_pair", f"WITH {_RIDGE2} SELECT vec_id, {s6('least(greatest((raw - m) / (s + 1e-10) / 2, -1), 1)')} AS score FROM y, z")
def scorer_fit_pair(spark, d):
    """Two features, of which SQL can solve the normal equations."""
    s = _samples(spark, d).withColumn("features", F.slice("features", 1, 2))
    return s.select("vec_id", r6(scorer.MovementScorer.fit(s, d=2).score(F.col("features"))).alias("score"))


@query("price_change", f"SELECT vec_id, {s6('embedding[25]::DOUBLE - embedding[9]::DOUBLE')} AS change FROM embeddings")
def price_change(spark, d):
    return _samples(spark, d).select("vec_id", r6(scorer.price_change(F.col("future"))).alias("change"))


_SCORER = scorer.MovementScorer((0.5, -0.25, 0.125, 1.0, -0.5, 0.25, 0.0, 0.75), 0.01, 0.2)


_WEIGHTS = f"""{_T_SQL},
mm AS (SELECT [{", ".join("[" + ", ".join(f"sum(x[{i}] * x[{j}])" + (" + 0.01::DOUBLE" if i == j else "") for j in range(1, 9)) + f", sum(x[{i}] * target)]" for i in range(1, 9))}] AS m FROM t),
gj AS (SELECT 0 AS k, m FROM mm UNION ALL SELECT k + 1, list_transform(range(1, 9), lambda r: CASE WHEN r = k + 1 THEN list_transform(m[r], lambda v: v / m[r][r])
  ELSE list_transform(range(1, 10), lambda c: m[r][c] - m[r][k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END) FROM gj WHERE k < 8),
wt AS (SELECT list_transform(range(1, 9), lambda r: m[r][9]) AS w FROM gj WHERE k = 8)"""


@query("weight_importance", f"WITH RECURSIVE {_WEIGHTS} SELECT unnest({list(MOVEMENT)}) AS feature, unnest(list_transform(w, lambda v: {s6('abs(v) / list_sum(list_transform(w, lambda u: abs(u)))')})) AS importance FROM wt")
def weight_importance(spark, d):
    fitted = scorer.MovementScorer.fit(_samples(spark, d))
    return spark.createDataFrame(list(fitted.importance().items()), "feature string, importance double").withColumn("importance", r6(F.col("importance")))  # eight rows


_P_SQL = f"""q AS (SELECT label AS cluster, embedding::DOUBLE[] AS x FROM embeddings), r AS (SELECT cluster, ({' + '.join(f'{w}::DOUBLE * (x[{9 + i}] + x[{17 + i}] + x[{25 + i}])' for i, w in enumerate(_SCORER.weights))}) / 3 AS raw FROM q),
s AS (SELECT cluster, least(greatest((raw - 0.01::DOUBLE) / (0.2::DOUBLE + 1e-10) / 2, -1), 1) AS score FROM r), m AS (SELECT cluster, avg(score) AS m, stddev_pop(score) AS d FROM s GROUP BY 1),
g AS (SELECT cluster, m AS mean, median(score) AS median, d AS std, avg(pow((score - m) / d, 3)) AS skew, avg(pow((score - m) / d, 4)) - 3 AS kurtosis,
  greatest(avg((score > 0)::INT), avg((score < 0)::INT)) AS consistency, stddev_samp(score) / sqrt(count(*)) AS sem, count(*) AS n FROM s JOIN m USING (cluster) GROUP BY cluster, m, d)"""
_P_NAMES = ("mean", "median", "std", "skew", "kurtosis", "consistency", "sem")


def _patterns(spark, d):
    return evaluate.pattern_performance(_samples(spark, d).withColumnRenamed("label", "cluster"), _SCORER)


@query("pattern_performance", f"WITH {_P_SQL} SELECT cluster::INT AS cluster, {', '.join(f'{s6(c)} AS {c}' for c in _P_NAMES)}, n FROM g")
def pattern_performance(spark, d):
    return _patterns(spark, d).select("cluster", *[r6(F.col(c)).alias(c) for c in _P_NAMES], "n")


#: p of Student's t by Simpson's rule: with t = sqrt(v) tan(a), the density is a power of cos(a). Quantiles by halving.
_SIMPSON = 2000


def _t_tail(t: str, v: str) -> str:
    """Twice the tail beyond t of Student's t with v degrees."""
    low, width = f"atan(({t}) / sqrt({v}))", f"((pi() / 2 - atan(({t}) / sqrt({v}))) / {_SIMPSON})"
    rule = f"list_sum(list_transform(range(0, {_SIMPSON} + 1), lambda k: CASE WHEN k % {_SIMPSON} = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(abs(cos({low} + k * {width})), {v} - 1)))"
    return f"(2 * exp(lgamma(({v} + 1) / 2.0::DOUBLE) - lgamma({v} / 2.0::DOUBLE)) / sqrt(pi()) * {width} / 3 * {rule})"


_P_VALUES = f"{_P_SQL}, gp AS (SELECT *, {_t_tail('abs(mean / sem)', '(n - 1)')} AS p_value FROM g)"


@query(
    "pattern_intervals",
    f"""WITH RECURSIVE {_P_VALUES}, hv AS (SELECT cluster, n, 0.0::DOUBLE AS lo, 700.0::DOUBLE AS hi, 0 AS k FROM g
  UNION ALL SELECT cluster, n, CASE WHEN tail > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN tail > 0.05 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM (SELECT *, {_t_tail('(lo + hi) / 2', '(n - 1)')} AS tail FROM hv WHERE k < 50))
SELECT gp.cluster::INT AS cluster, {s6('p_value')} AS p_value, {s6('mean - lo * sem')} AS lower, {s6('mean + lo * sem')} AS upper FROM gp JOIN hv ON hv.cluster = gp.cluster AND k = 50""",
)
def pattern_intervals(spark, d):
    return evaluate.with_t_interval(_patterns(spark, d)).select("cluster", *[r6(F.col(c)).alias(c) for c in ("p_value", "lower", "upper")])


@query("pattern_selection", f"WITH {_P_VALUES} SELECT cluster::INT AS cluster, {s6('abs(mean) * (1 - std) * consistency')} AS score, CASE WHEN mean > 0 THEN 1 ELSE -1 END AS side FROM gp WHERE p_value < 0.05 AND consistency >= 0.5")
def pattern_selection(spark, d):
    found = evaluate.significant_patterns(evaluate.with_t_interval(_patterns(spark, d)), 0.05, 0.5)
    return found.select("cluster", r6(F.col("score")).alias("score"), "side")


@query(
    "scorer_fit",
    f"""WITH RECURSIVE {_WEIGHTS}, y AS (SELECT vec_id, list_sum(list_transform(range(1, 9), lambda i: w[i] * x[i])) AS raw FROM t, wt), z AS (SELECT avg(raw) AS m, stddev_pop(raw) AS s FROM y)
SELECT vec_id, {s6("least(greatest((raw - m) / (s + 1e-10) / 2, -1), 1)")} AS score FROM y, z""",
)
def scorer_fit(spark, d):
    s = _samples(spark, d)
    m = scorer.MovementScorer.fit(s)
    return s.select("vec_id", r6(m.score(F.col("features"))).alias("score"))


# stability

_B_SQL = "q AS (SELECT vec_id, (vec_id // 50)::INT AS batch, label::INT AS cluster, embedding::DOUBLE[] AS x FROM embeddings)"


def _batches(spark, d):
    return _vectors(spark, d).select("vec_id", F.expr("int(vec_id div 50)").alias("batch"), F.col("label").alias("cluster"), "features")


@query("label_stability", f"WITH {_B_SQL}, g AS (SELECT b.batch, c.k, count(q.vec_id) / any_value(b.n)::DOUBLE AS p FROM (SELECT batch, count(*) AS n FROM q GROUP BY 1) b CROSS JOIN range(0, 10) c(k) LEFT JOIN q ON q.batch = b.batch AND q.cluster = c.k GROUP BY 1, 2), e AS (SELECT batch, abs(p - lag(p) OVER (PARTITION BY k ORDER BY batch)) AS a FROM g) SELECT batch, {s6('coalesce(1 - avg(a), 1)')} AS stability FROM e GROUP BY 1")
def label_stability(spark, d):
    return stability.label_stability(_batches(spark, d), 10).select("batch", r6(F.col("stability")).alias("stability"))


_RADII = """ctr AS (SELECT batch, cluster, list(m ORDER BY i) AS c FROM (SELECT batch, cluster, i, avg(v) AS m FROM (SELECT batch, cluster, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM q) GROUP BY ALL) GROUP BY 1, 2),
rad AS (SELECT q.batch, q.cluster, count(*) AS n, avg(list_distance(x, c)) AS radius FROM q JOIN ctr USING (batch, cluster) GROUP BY 1, 2)"""


@query("density_stability", f"WITH {_B_SQL}, {_RADII}, g AS (SELECT batch, coalesce(avg(1 / (radius + 1e-10)) FILTER (n >= 2), 0) AS density FROM rad GROUP BY 1) SELECT batch, {s6('density')} AS density, {s6('coalesce(1 - abs(density - lag(density) OVER (ORDER BY batch)), 1)')} AS stability FROM g")
def density_stability(spark, d):
    return stability.density_stability(_batches(spark, d)).select("batch", r6(F.col("density")).alias("density"), r6(F.col("stability")).alias("stability"))


@query(
    "bayes_stability",
    f"""WITH {_B_SQL}, {_RADII}, g AS (SELECT b.batch, c.k, ln(coalesce(exp(-radius * radius / 2) / sqrt(2 * pi()), 0) + 1e-10) AS l FROM (SELECT DISTINCT batch FROM q) b CROSS JOIN range(0, 10) c(k) LEFT JOIN rad ON rad.batch = b.batch AND rad.cluster = c.k),
s AS (SELECT batch, k, sum(l) OVER (PARTITION BY k ORDER BY batch) AS s FROM g), e AS (SELECT batch, k, exp(s - max(s) OVER (PARTITION BY batch)) AS e FROM s), p AS (SELECT batch, k, e / sum(e) OVER (PARTITION BY batch) AS p FROM e),
f AS (SELECT batch, abs(p - coalesce(lag(p) OVER (PARTITION BY k ORDER BY batch), 0.1::DOUBLE)) AS a FROM p) SELECT batch, {s6("1 - avg(a)")} AS stability FROM f GROUP BY 1""",
)
def bayes_stability(spark, d):
    return stability.bayes_stability(_batches(spark, d), 10).select("batch", r6(F.col("stability")).alias("stability"))


@query(
    "cusum_score",
    f"""WITH RECURSIVE {_B_SQL}, m AS (SELECT batch, avg(list_aggregate(x, 'avg')) AS m FROM q GROUP BY 1), i AS (SELECT batch, m, row_number() OVER (ORDER BY batch) AS i, avg(m) OVER w AS a, stddev_pop(m) OVER w AS s FROM m WINDOW w AS (ORDER BY batch ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)),
z AS (SELECT batch, i, CASE WHEN i > 2 THEN (m - a) / CASE WHEN s = 0 THEN 1e-10 ELSE s END ELSE 0 END AS z FROM i),
c AS (SELECT batch, i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM z WHERE i = 1 UNION ALL SELECT z.batch, z.i, greatest(0, up + z), greatest(0, down - z) FROM c JOIN z ON z.i = c.i + 1)
SELECT batch, {s6("least(greatest(up, down) / 2, 1)")} AS change FROM c""",
)
def cusum_score(spark, d):
    return stability.cusum(_batches(spark, d)).select("batch", r6(F.col("change")).alias("change"))


@query(
    "histogram_drift",
    f"""WITH {_B_SQL}, u AS (SELECT batch, unnest(x) AS v FROM q), g AS (SELECT min(v) AS a, (max(v) - min(v)) / 20 AS w FROM u WHERE batch = 0),
h AS (SELECT batch, greatest(least(floor((v - a) / w), 19), 0)::INT AS b, count(*) AS n FROM u, g GROUP BY 1, 2), t AS (SELECT batch, sum(n) AS t FROM h GROUP BY 1),
p AS (SELECT t.batch, k, coalesce(n, 0) / t::DOUBLE AS p FROM t CROSS JOIN range(0, 20) r(k) LEFT JOIN h ON h.batch = t.batch AND h.b = k),
l AS (SELECT batch, p, lag(p) OVER (PARTITION BY k ORDER BY batch) AS o FROM p),
j AS (SELECT batch, sum((CASE WHEN p > 0 THEN p * ln(p / ((p + o) / 2)) ELSE 0 END + CASE WHEN o > 0 THEN o * ln(o / ((p + o) / 2)) ELSE 0 END) / 2) AS js FROM l GROUP BY 1)
SELECT batch, {s6("CASE WHEN row_number() OVER (ORDER BY batch) <= 2 THEN 1 ELSE 1 - sqrt(greatest(js, 0)) END")} AS stability FROM j""",
)
def histogram_drift(spark, d):
    v = _batches(spark, d).select("batch", F.explode("features").alias("value"))
    return stability.histogram_drift(v).select("batch", r6(F.col("stability")).alias("stability"))


def _exact(name: str) -> str:
    """The SQL of a query without its rounding."""
    return re.sub(r"round\((.*?), 6\) \+ 0\.0 AS", r"(\1) AS", registry.ORACLES[name])


_OVERALL = "0.25 * (1 - change) + 0.25 * distribution + 0.15 * online + 0.2 * density + 0.15 * bayes"
_ONLINE = _exact("histogram_drift").replace("unnest(x) AS v FROM q", "list_aggregate(x, 'avg') AS v FROM q")


@query(
    "stability_report",
    f"""SELECT batch, {", ".join(f"{s6(c)} AS {c}" for c in ("change", "distribution", "online", "density", "bayes"))}, {s6(_OVERALL)} AS overall FROM ({_exact("cusum_score")}) JOIN (SELECT batch, stability AS distribution FROM ({_exact("label_stability")})) USING (batch)
JOIN (SELECT batch, stability AS online FROM ({_ONLINE})) USING (batch) JOIN (SELECT batch, stability AS density FROM ({_exact("density_stability")})) USING (batch) JOIN (SELECT batch, stability AS bayes FROM ({_exact("bayes_stability")})) USING (batch)""",
)
def stability_report(spark, d):
    out = stability.report(_batches(spark, d), 10)
    return out.select("batch", *[r6(F.col(c)).alias(c) for c in out.columns if c != "batch"])


@query(
    "memory_weights",
    f"""WITH {_B_SQL}, u AS (SELECT batch, unnest(x) AS v FROM q), m AS (SELECT batch, avg(v) AS m, stddev_pop(v) AS s FROM u GROUP BY 1), o AS (SELECT batch, avg(abs(v - m) / (s + 1e-10)) AS d FROM u JOIN m USING (batch) GROUP BY 1),
n AS (SELECT batch, count(*) AS n, row_number() OVER (ORDER BY batch) - 1 AS h FROM q GROUP BY 1), w AS (SELECT batch, n, exp(-d) * CASE WHEN h = 0 THEN 1 ELSE (SELECT avg(exp(-0.1 * i)) FROM range(0, 1000) t(i) WHERE i < h) END AS raw FROM n JOIN o USING (batch))
SELECT batch, {s6("raw / (n * raw + 1e-10)")} AS weight FROM w""",
)
def memory_weights(spark, d):
    return stability.memory_weights(_batches(spark, d)).select("batch", r6(F.col("weight")).alias("weight"))


# charts


@query("cluster_chart", f"WITH {L_SQL} SELECT series_id, pos, value, CASE WHEN pos % 2 = 0 THEN cluster ELSE -1 END::INT AS cluster FROM l")
def cluster_chart(spark, d):
    l = _labels(spark, d)
    return charts.clusters(l, l.where("pos % 2 = 0"))


@query("equity_benchmark", f"WITH {R_SQL} SELECT series_id, pos, {s6('sum(returns) OVER w')} AS equity, {s6('sum(returns / 2) OVER w')} AS benchmark FROM r WINDOW w AS (PARTITION BY series_id ORDER BY pos)")
def equity_benchmark(spark, d):
    r = _returns(spark, d)
    out = charts.equity(r, r.withColumn("returns", F.col("returns") / 2))
    return out.select(SERIES, "pos", r6(F.col("equity")).alias("equity"), r6(F.col("benchmark")).alias("benchmark"))


@query("cluster_performance", f"WITH {_HOLD_METRICS}, m AS (SELECT cluster::INT AS cluster, side, {s6('compounded / nullif(ulcer, 0)')} AS martin, {s6('sharpe')} AS sharpe, {s6('win_rate')} AS win_rate FROM z) SELECT cluster, side, unnest(['martin', 'sharpe', 'win_rate']) AS metric, unnest([martin, sharpe, win_rate]) AS value FROM m")
def cluster_performance(spark, d):
    l = _labels(spark, d)
    out = charts.cluster_performance(evaluate.holding_metrics(l, l, 6, 1), ("martin", "sharpe", "win_rate"))
    return out.select("cluster", "side", "metric", r6(F.col("value")).alias("value"))


@query("grid_regularize", f"WITH {E_SQL}, k AS (SELECT *, date_trunc('minute', ts) AS m FROM e), t AS (SELECT series_id, min(epoch_us(m)) AS t0 FROM k GROUP BY 1) SELECT series_id, make_timestamp(t0 + floor((epoch_us(m) - t0) / 86400000000)::BIGINT * 86400000000) AS ts, sum(1.0::DOUBLE) AS volume FROM k JOIN t USING (series_id) WHERE (epoch_us(m) - t0) % 1800000000 = 0 GROUP BY series_id, t0, floor((epoch_us(m) - t0) / 86400000000)")
def grid_regularize(spark, d):
    m = _ticks(spark, d).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    prices = m.select(SERIES, "ts", "event_id", *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    return bars.resample(prices, "30min", "1day", ties=("event_id",)).select(SERIES, "ts", "volume")


@query("transform_windows", f"WITH {W_SQL}, {_HAAR}, k AS (SELECT series_id, pos, k, v, row_number() OVER (PARTITION BY series_id, pos ORDER BY k) AS i, avg(v) OVER p AS m, stddev_pop(v) OVER p AS s FROM t WHERE best <= 4 WINDOW p AS (PARTITION BY series_id, pos)) SELECT series_id, pos, (i - 1)::INT AS i, {s6('(v - m) / (s + 1e-10)')} AS x FROM k")
def transform_windows(spark, d):
    reduce = reducers.reducer("Wavelet", 4, "haar")
    return _each(features.transform_windows(_windows(spark, d), reduce, 4), "features", SERIES, "pos")


# the pipeline


def _config(**more) -> miner.Config:
    return miner.Config(n_clusters=6, evaluator_params={"min_samples": 10}, **more)


_FIXED = [[-1.2, 0.0, 1.2], [1.2, 0.0, -1.2], [-0.7, 1.4, -0.7], [0.7, -1.4, 0.7]]


def _fixed_miner(e: DataFrame) -> miner.Miner:
    """A model with given centers and sides instead of fitted ones, scaled by e."""
    m = miner.Miner(miner.Config(n_lookback=LENGTH, n_pivots=3, n_clusters=4, dist_measure=3))
    m.centers, m.long, m.short, m.scaling = _FIXED, [0], [1], cleaning.scaling(e, "value", "asinh")
    return m


_MINER_SQL = f"""{E_SQL}, mm AS (SELECT series_id, min(asinh(value)) AS lo, max(asinh(value)) AS hi FROM e GROUP BY 1), sc AS (SELECT e.series_id, pos, CASE WHEN lo = hi THEN 0.0 ELSE (asinh(value) - lo) / (hi - lo) END AS y FROM e JOIN mm USING (series_id)),
w AS (SELECT * FROM (SELECT series_id, pos, list(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS x FROM sc) WHERE len(x) = {LENGTH}),
p AS (SELECT series_id, pos, any_value(x) AS x, arg_max(i, (round(abs(x[1] + (x[{LENGTH}] - x[1]) / {LENGTH - 1} * i - x[i + 1]), 12), -i)) AS best FROM (SELECT *, unnest(range(1, {LENGTH - 1})) AS i FROM w) GROUP BY 1, 2),
f AS (SELECT series_id, pos, [x[1], x[best + 1], x[{LENGTH}]] AS f, lag(x[best + 1]) OVER (PARTITION BY series_id ORDER BY pos) AS b FROM p),
z AS (SELECT series_id, pos, list_transform(f, lambda v: (v - list_aggregate(f, 'avg')) / (list_aggregate(f, 'stddev_pop') + 1e-10)) AS z FROM f WHERE b IS NULL OR f[2] <> b),
d AS (SELECT series_id, pos, cluster, list_distance(z, center) AS dist FROM z, (VALUES {", ".join(f"({i}, {c}::DOUBLE[])" for i, c in enumerate(_FIXED))}) c(cluster, center))"""


@query("miner_predict", f"WITH {_MINER_SQL} SELECT series_id, pos, arg_min(cluster, (dist, cluster))::INT AS cluster, {s6('min(dist)')} AS distance FROM d GROUP BY 1, 2")
def miner_predict(spark, d):
    e = _events(spark, d).select(SERIES, "pos", "value")
    return _fixed_miner(e).predict(e).select(SERIES, "pos", "cluster", r6(F.col("distance")).alias("distance"))


@query(
    "miner_fixed_signals",
    f"""WITH {_MINER_SQL}, q AS (SELECT series_id, pos, cluster, exp(min(dist) OVER (PARTITION BY series_id, pos) - dist) AS e FROM d), s AS (SELECT series_id, pos, sum(e) FILTER (cluster = 0) / sum(e) AS up, sum(e) FILTER (cluster = 1) / sum(e) AS down FROM q GROUP BY 1, 2)
SELECT series_id, pos, CASE WHEN up > 0.6 AND up > down THEN 1 WHEN down > 0.6 AND down > up THEN -1 ELSE 0 END AS signal,
  round(CASE WHEN up > 0.6 AND up > down THEN up WHEN down > 0.6 AND down > up THEN down ELSE greatest(1 - (up + down), 0) END, 6) + 0.0 AS confidence FROM s""",
)
def miner_fixed_signals(spark, d):
    e = _events(spark, d).select(SERIES, "pos", "value")
    return _fixed_miner(e).signals(e).select(SERIES, "pos", "signal", r6(F.col("confidence")).alias("confidence"))


_DRIFT_SQL = "coalesce(asinh(value) - lag(asinh(value)) OVER (PARTITION BY series_id ORDER BY pos), 0) / 10 / 1000 + 0.0002::DOUBLE"


def _chain_sql(steps: int) -> str:
    """Features, Lloyd's steps from the fixed centers, what clusters earn, and the sides that are chosen."""
    parts = [_MINER_SQL, f"c0 AS (SELECT * FROM (VALUES {', '.join(f'({i}, {c}::DOUBLE[])' for i, c in enumerate(_FIXED))}) c(cluster, center))"]
    near = "SELECT series_id, pos, any_value(z) AS z, arg_min(cluster, (dist, cluster)) AS cluster FROM (SELECT series_id, pos, z, cluster, list_distance(z, center) AS dist FROM z, c{}) GROUP BY 1, 2"
    for k in range(steps):
        mean = f"SELECT cluster, list(m ORDER BY i) AS center FROM (SELECT cluster, i, avg(e) AS m FROM (SELECT cluster, unnest(z) AS e, unnest(range(0, 3)) AS i FROM ({near.format(k)})) GROUP BY 1, 2) GROUP BY 1"
        parts.append(f"c{k + 1} AS (SELECT c{k}.cluster, coalesce(m.center, c{k}.center) AS center FROM c{k} LEFT JOIN ({mean}) m USING (cluster))")
    parts += [
        f"l AS (SELECT series_id, pos, cluster FROM ({near.format(steps)}))",
        f"r AS (SELECT series_id, pos, {_DRIFT_SQL} AS returns FROM e)",
        _hold_sql("l", 6),
        "side AS (SELECT unnest([1, -1]) AS side)",
        "g AS (SELECT hp.series_id, hp.cluster, side, hp.pos, r.returns * side AS returns FROM hp JOIN r USING (series_id, pos), side WHERE cluster IN (SELECT cluster FROM l GROUP BY 1 HAVING count(*) >= 10))",
        _metric_sql("cluster, side", "g", "series_id, pos"),
        "bs AS (SELECT *, compounded / nullif(ulcer, 0) AS mt, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(compounded / nullif(ulcer, 0), '-infinity'::DOUBLE) DESC, side) AS k FROM z2)",
        "chosen AS (SELECT cluster, side AS selected FROM bs WHERE k = 1 AND mt > 0 AND avg_return > 0 AND abs(0.4 * mt + 0.3 * coalesce(sharpe, 0) + 0.2 * coalesce(profit_factor, 0) + 0.1 * coalesce(win_rate, 0)) > 0)",
    ]
    sql = "WITH RECURSIVE " + ", ".join(parts).replace("z AS (SELECT cluster, side, sum(returns)", "z2 AS (SELECT cluster, side, sum(returns)")
    return sql + f" SELECT cluster::INT AS cluster, side, coalesce(selected, 0)::INT AS selected, {_SHOWN_SQL} FROM z2 LEFT JOIN chosen USING (cluster)"


@query("miner_chain", _chain_sql(2))
def miner_chain(spark, d):
    """Fit from fixed centers and evaluate: scaling, windows, features, clusters, holding periods, selection."""
    e = _events(spark, d).select(SERIES, "pos", "value")
    m = miner.Miner(miner.Config(n_lookback=LENGTH, n_pivots=3, n_clusters=4, dist_measure=3, model_type="sequential", evaluator_params={"min_samples": 10}))
    r = _drifting(_returns(spark, d))
    m.fit(e, r, start=_FIXED, max_iter=2)
    return _shown(m.evaluate(e, r), "cluster", "side", "selected")


def _cv_sql(splits: int) -> str:
    """The chain for each fold: scaled, and clusters chosen, by its train part, measured on its test part."""
    start = _MINER_SQL.index("w AS (SELECT * FROM (SELECT series_id")
    features = _MINER_SQL[start : _MINER_SQL.index("d AS (SELECT series_id, pos, cluster, list_distance(z")].rstrip().rstrip(",")
    center = ", ".join(f"({i}, {c}::DOUBLE[])" for i, c in enumerate(_FIXED))
    score = "0.4 * mt + 0.3 * coalesce(sharpe, 0) + 0.2 * coalesce(profit_factor, 0) + 0.1 * coalesce(win_rate, 0)"
    train = _metric_sql("cluster, side", "g", "series_id, pos").replace("z AS (SELECT cluster, side, sum(returns)", "z2 AS (SELECT cluster, side, sum(returns)")
    test = _metric_sql("fold", "tg", "series_id, pos")
    for old, new in (("x AS (SELECT fold", "xx AS (SELECT fold"), ("FROM x)", "FROM xx)"), ("y AS (SELECT *", "yy AS (SELECT *"), ("FROM y GROUP BY", "FROM yy GROUP BY"), ("z AS (SELECT fold", "zz AS (SELECT fold")):
        test = test.replace(old, new)
    names = miner.CV_METRICS
    parts = [
        E_SQL,
        "n AS (SELECT series_id, max(pos) + 1 AS n FROM e GROUP BY 1)",
        f"ret AS (SELECT series_id, pos, {_DRIFT_SQL} AS returns FROM e)",
        f"fo AS (SELECT e.series_id AS sid, e.pos, value, returns, k AS fold, n // {splits + 1} AS size, n - ({splits} - k) * (n // {splits + 1}) AS s FROM e JOIN n USING (series_id) JOIN ret ON ret.series_id = e.series_id AND ret.pos = e.pos, range(0, {splits}) r(k))",
        "ef AS (SELECT fold, sid, CASE WHEN pos < s THEN 'train' ELSE 'test' END AS part, CASE WHEN pos < s THEN pos ELSE pos - s END AS pos, value, returns FROM fo WHERE pos < s + size)",
        "mm AS (SELECT fold, sid, min(asinh(value)) AS lo, max(asinh(value)) AS hi FROM ef WHERE part = 'train' GROUP BY 1, 2)",
        "sc AS (SELECT fold || '|' || part || '|' || sid AS series_id, pos, CASE WHEN lo = hi THEN 0.0 ELSE (asinh(value) - lo) / (hi - lo) END AS y FROM ef JOIN mm USING (fold, sid))",
        features,
        f"al AS (SELECT series_id, pos, split_part(series_id, '|', 1)::INT AS fold, split_part(series_id, '|', 2) AS part, split_part(series_id, '|', 1)::INT * {len(_FIXED)} + arg_min(c.cluster, (list_distance(z, center), c.cluster)) AS cluster FROM z, (VALUES {center}) c(cluster, center) GROUP BY 1, 2)",
        "l AS (SELECT series_id, pos, cluster FROM al WHERE part = 'train')",
        "r AS (SELECT fold || '|' || part || '|' || sid AS series_id, pos, returns FROM ef)",
        _hold_sql("l", 6),
        "side AS (SELECT unnest([1, -1]) AS side)",
        "g AS (SELECT hp.series_id, hp.cluster, side, hp.pos, r.returns * side AS returns FROM hp JOIN r USING (series_id, pos), side WHERE cluster IN (SELECT cluster FROM l GROUP BY 1 HAVING count(*) >= 10))",
        train,
        "bs AS (SELECT *, compounded / nullif(ulcer, 0) AS mt, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(compounded / nullif(ulcer, 0), '-infinity'::DOUBLE) DESC, side) AS k FROM z2)",
        f"chosen AS (SELECT cluster, side FROM bs WHERE k = 1 AND mt > 0 AND avg_return > 0 AND abs({score}) > 0)",
        "tg AS (SELECT fold, al.series_id, al.pos, returns * coalesce(side, 0) AS returns FROM al JOIN r USING (series_id, pos) LEFT JOIN chosen USING (cluster) WHERE part = 'test')",
        test,
        "mv AS (SELECT fold, compounded / nullif(ulcer, 0) AS martin, sharpe, profit_factor, win_rate, max_drawdown FROM zz)",
        f"lo AS (SELECT fold, unnest({list(names)}) AS metric, unnest([{', '.join(names)}]) AS value FROM mv)",
    ]
    shown = f"SELECT fold, metric, {s6('value')} AS value, {s6('avg(value) OVER (PARTITION BY metric)')} AS mean, {s6('stddev_pop(value) OVER (PARTITION BY metric)')} AS std FROM lo"
    return "WITH RECURSIVE " + ", ".join(parts) + " " + shown


@query("cross_validation", _cv_sql(3))
def cross_validation(spark, d):
    """Three expanding folds at once, with fixed centers: what their own sides earn after them."""
    e = _events(spark, d).select(SERIES, "pos", "value")
    config = miner.Config(n_lookback=LENGTH, n_pivots=3, n_clusters=4, dist_measure=3, evaluator_params={"min_samples": 10})
    out = miner.cv_table(miner.cross_validation(config, e, 3, _FIXED, _drifting(_returns(spark, d))))
    return out.select("fold", "metric", *[r6(F.col(c)).alias(c) for c in ("value", "mean", "std")])


@query("miner_evaluate")
def miner_evaluate(spark, d):
    e = _events(spark, d).select(SERIES, "pos", "value")
    m = miner.Miner(_config())
    m.fit(e)
    return _shown(m.evaluate(e), "cluster", "side", "selected")


@query("miner_signals")
def miner_signals(spark, d):
    e = _events(spark, d).select(SERIES, "pos", "value")
    m = miner.Miner(_config(reducer_type="FFT"))
    m.fit(e)
    return m.signals(e).select(SERIES, "pos", "signal", r6(F.col("confidence")).alias("confidence"))
