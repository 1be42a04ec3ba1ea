"""Series operators on small inputs with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelode.functions import metrics
from tidelode.operators import bars, cleaning, cluster, evaluate, features, hold, ordered, reducers, scorer, windows
from tidelode.schema import DataError

T0 = dt.datetime(2024, 1, 1)
BAR = "series_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def minutes(*m):
    return [T0 + dt.timedelta(minutes=x) for x in m]


def series(spark, values, name="a", column="value"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], f"series_id string, pos long, {column} double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("pos",))).collect()]


def test_align_never_looks_ahead(spark):
    fine = spark.createDataFrame([("a", t) for t in minutes(*range(14))], "series_id string, ts timestamp_ntz")
    coarse = spark.createDataFrame([("a", t, v) for t, v in zip(minutes(0, 5, 10), (10, 20, 30), strict=True)], "series_id string, ts timestamp_ntz, value long")
    assert column(bars.align(fine, coarse, "1min"), "aligned", "ts") == [None] + [10] * 5 + [20] * 5 + [30] * 3
    assert column(bars.align(fine, coarse, "1min", strict_tail=True), "aligned", "ts") == [None] + [10] * 5 + [20] * 8
    assert column(bars.align(fine, coarse, "1min", bucket="2min"), "aligned", "ts") == [None] + [10] * 5 + [20] * 5 + [30] * 3


def test_resample_origin(spark):
    rows = [("a", t, float(i), float(i), float(i), float(i), float(i)) for i, t in enumerate(minutes(*range(3, 15)))]
    df = spark.createDataFrame(rows, BAR)
    out = bars.resample(df, "1min", "5min").orderBy("ts").collect()
    assert [(r["ts"], r["volume"]) for r in out] == list(zip(minutes(3, 8, 13), (10, 35, 21), strict=True))
    assert (out[0]["open"], out[0]["close"], out[0]["high"], out[0]["low"]) == (0, 4, 4, 0)
    shifted = bars.resample(df, "1min", "5min", buffer=2).orderBy("ts").collect()
    assert [(r["ts"], r["volume"]) for r in shifted] == list(zip(minutes(0, 5, 10), (1, 20, 45), strict=True))
    with pytest.raises(DataError):
        bars.resample(df, "5min", "1min")
    off = df.union(spark.createDataFrame([("a", T0 + dt.timedelta(seconds=200), 9.0, 9.0, 9.0, 9.0, 100.0)], BAR))
    assert bars.resample(off, "1min", "5min").agg(F.sum("volume")).first()[0] == 66


def test_round_keep_last(spark):
    rows = [("a", T0 + dt.timedelta(seconds=s), v) for s, v in ((30, 1), (90, 2), (150, 3))]
    out = cleaning.round_keep_last(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, v long"), "1min")
    assert [tuple(r)[1:] for r in out.orderBy("ts").collect()] == [(T0, 1), (T0 + dt.timedelta(minutes=2), 3)]


def test_chunks_and_buckets_change_nothing(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(minutes=rng.randrange(5000)), i, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, k long, value double")
    a = ordered.number_rows(df, "k")
    b = ordered.number_rows(df, "k", bucket="7min")
    assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    for chunk in (5, 7, 64):
        lag = {"x": lambda w: F.lag("value", 3).over(w), "y": lambda w: F.lead("value", 2).over(w)}
        small = ordered.framed(a, lag, before=3, after=2, chunk=chunk)
        assert sorted(map(str, small.collect())) == sorted(map(str, ordered.framed(a, lag, before=3, after=2).select(*small.columns).collect()))
        for kind in ("sum", "max"):
            one = {(r[0], r[1]): r[2] for r in ordered.running(a, "z", F.col("value"), kind, chunk).select("series_id", "pos", "z").collect()}
            two = {(r[0], r[1]): r[2] for r in ordered.running(a, "z", F.col("value"), kind).select("series_id", "pos", "z").collect()}
            assert one == pytest.approx(two)


def test_percentiles_and_usual_volume(spark):
    rng = random.Random(3)
    rows = [(s, v) for s, n in (("a", 3000), ("b", 99), ("c", 1), ("d", 2), ("e", 1200)) for v in (rng.choice((round(rng.gauss(0, 1), 2), rng.gauss(0, 9))) for _ in range(n))]
    rows += [("e", None)] * 5 + [("f", None)] + [("g", 4.0)] * 1000 + [("g", 5.0)]
    df = spark.createDataFrame(rows, "series_id string, value double")
    shares = [0.0, 0.00001, 0.15, 0.5, 0.85, 0.999, 1.0]
    want = df.where("value is not null").groupBy("series_id").agg(F.percentile("value", F.array(*map(F.lit, shares))).alias("q"))
    for accuracy in (100, 1000, 10_000):
        got = cleaning.percentiles(df, "value", shares, accuracy)
        assert {r[0]: r[1] for r in got.collect()} == {r[0]: r[1] for r in want.collect()}
    assert cleaning.winsorize(df, "value").where("series_id = 'f'").count() == 1
    bars_ = [("a", p, 3.0, 1.0, 2.0, v) for p, v in enumerate((0.0, 0.0, 7.0, 7.0, None))] + [("b", 0, 3.0, 1.0, 2.0, None)]
    out = cleaning.volume_proxy(spark.createDataFrame(bars_, "series_id string, pos long, high double, low double, close double, volume double"))
    assert sorted(map(tuple, out.select("series_id", "pos", "volume").collect())) == [("a", 0, None), ("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, 2.0), ("a", 4, 2.0), ("b", 0, None)]


def test_windows(spark):
    df = series(spark, range(6))
    w = windows.sliding(df, 3, target=True)
    assert column(w, "window") == [[0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5]] and column(w, "target") == [3, 4, 5, None]
    assert column(windows.difference(series(spark, [1, 4, 2])), "diff") == [0, 3, -2]
    r = series(spark, [1, -2, 3], column="returns")
    assert column(windows.drawdown(r), "drawdown") == [0, -2, 0] and column(windows.cumulative(r), "equity") == [1, -1, 2]
    parts = windows.folds(series(spark, range(12)), 5)
    for f in range(5):
        assert column(parts.where(f"fold = {f} and part = 'test'"), "pos") == [2 + 2 * f, 3 + 2 * f]
        assert parts.where(f"fold = {f} and part = 'train'").count() == 2 + 2 * f
    assert windows.split(series(spark, range(10))).where("part = 'train'").count() == 7
    assert windows.sliding(series(spark, range(2)), 3).count() == 0


def test_repeats_and_scores(spark):
    rows = [[0, 1, 1, 0], [5, 1, 1, 5], [0, 2, 1, 0], [0, 1, 1, 0], [0, 1, 1, 0]]
    df = spark.createDataFrame([("a", i, [float(x) for x in r]) for i, r in enumerate(rows)], "series_id string, pos long, features array<double>")
    assert column(features.drop_repeats(df, 4), "pos") == [0, 2, 3]
    z = column(features.zscore_rows(df), "features")
    assert sum(z[2]) == pytest.approx(0, abs=1e-9)
    assert column(features.drop_repeats(df, 2), "pos") == [0, 1, 2, 3]


def test_fft(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 3.0],)], "w array<double>")
    assert df.select(reducers.fft(F.col("w"), 4)).first()[0] == pytest.approx([10, 3.16228, 0, 3.16228], abs=1e-5)
    assert df.select(reducers.fft(F.col("w"), 2)).first()[0] == pytest.approx([10, 3.16228], abs=1e-5)
    with pytest.raises(DataError):
        reducers.fft_wavelet(F.col("w"), 1)


def test_hold(spark):
    df = series(spark, range(6)).withColumn("pos", F.element_at(F.array(*[F.lit(x) for x in (0, 2, 5, 6, 7, 13)]), F.col("pos").cast("int") + 1).cast("long"))
    assert column(hold.accept(df, 5), "pos") == [0, 6, 13]
    rng = random.Random(2)
    signals = sorted({rng.randrange(300) for _ in range(120)})
    s = spark.createDataFrame([("a", p) for p in signals], "series_id string, pos long")
    for h in (0, 3, 8):
        want, last = [], -(10**9)
        for p in signals:
            if p > last + h:
                want.append(p)
                last = p
        assert column(hold.accept(s, h), "pos") == want
        if h:
            positions = column(hold.held(s, h), "pos")
            assert len(positions) == len(set(positions)) == h * len(want)


def test_hold_over_chunks(spark):
    rng = random.Random(5)
    for n, span in ((400, 500), (60, 4000), (3000, 3000)):
        signals = sorted(rng.sample(range(span), n))
        s = spark.createDataFrame([("a", p) for p in signals] + [("b", p + 7) for p in signals[::3]], "series_id string, pos long")
        for h in (0, 3, 8):
            want = []
            for name, ps in (("a", signals), ("b", [p + 7 for p in signals[::3]])):
                last = -(10**9)
                for p in ps:
                    if p > last + h:
                        want.append((name, p))
                        last = p
            assert sorted(map(tuple, hold.accept(s, h, chunk=9).collect())) == want
    dense = spark.range(1_000_000).select(F.lit("a").alias("series_id"), F.col("id").alias("pos"))
    assert hold.accept(dense, 6).agg(F.count(F.lit(1)), F.max("pos")).first() == (142858, 999999)
    p = hold.accept(s, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in p and "Python" not in p


def test_movement_vectors_by_hand(spark):
    """The recurrences again, window by window; chunks of a series give what the whole series gives."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=900)) + 50
    length, settings = 12, dict(normalize_window=30, lookback=4, trend_window=5, alpha=0.2)
    w = windows.sliding(series(spark, x.tolist()), length)
    got = {r["pos"]: r["features"] for r in reducers.movement_vectors(w, 16, chunk=1, **settings).collect()}
    names = ("price_std", "price_mean", "speed_std", "speed_mean", "vol_std")
    stats, past, moved, last_speed = dict.fromkeys(names, 1.0) | {"price_mean": 0.0, "speed_mean": 0.0}, [], [], None
    for pos in range(length - 1, len(x)):
        cur = x[pos - length + 1 : pos + 1]
        h = np.concatenate(past[-3:]) if past else cur
        past.append(cur)
        c = h[1:] - h[:-1]
        rc = c[-(min(30, len(h)) - 1) :] if len(c) > 30 else c
        at = np.arange(1, len(rc) + 1)
        new = dict(zip(names, (c.std() + 1e-10, h[-30:].mean(), (rc / at).std() + 1e-10, np.abs(rc).mean() / at.mean(), np.abs(rc).std() + 1e-10), strict=True))
        stats = {k: 0.8 * stats[k] + 0.2 * v for k, v in new.items()}
        line = cur[0] + (cur[-1] - cur[0]) * np.arange(length) / (length - 1)
        pivots = [0, int(np.abs(line - cur)[1:-1].argmax()) + 1, length - 1] if abs(cur[-1] - cur[0]) >= (cur.max() - cur.min()) * 0.001 else [0, length - 1]
        mean5 = np.array([cur[max(i - 4, 0) : max(i - 4, 0) + 5].mean() for i in range(length)])
        trend = np.clip((cur - mean5) / (cur.std() + 1e-10), -1, 1)
        want, moves = [], list(zip(pivots[:-1], pivots[1:], strict=True))
        for a, b in moves:
            d, t = cur[b] - cur[a], b - a
            size = d / (np.mean(np.abs(moved[-30:])) + 1e-10) if moved else 1.0
            want += [(d - stats["price_mean"]) / stats["price_std"], t, np.arctan2(d, t) / np.pi, (d / t - stats["speed_mean"]) / stats["speed_std"]]
            want += [0.0 if last_speed is None else d / t - last_speed, size, np.diff(cur[a : b + 1]).std() / stats["vol_std"], trend[a : b + 1].mean()]
            last_speed = d / t
        moved.append(cur[moves[-1][1]] - cur[moves[-1][0]])
        want += [0.0] * (16 - len(want))
        assert got[pos] == pytest.approx(want, rel=1e-6, abs=1e-9), pos


def test_metrics(spark):
    r = [0.1, -0.05, 0.2, 0.0, -0.1]
    row = metrics.performance(series(spark, r, column="returns"), ["series_id"]).first()
    equity, peak, dd = 1.0, 1.0, []
    for x in r:
        equity *= 1 + x
        peak = max(peak, equity)
        dd.append(equity / peak - 1)
    ulcer = (sum(x * x for x in dd) / 4) ** 0.5
    assert row["compounded"] == pytest.approx(equity - 1) and row["ulcer"] == pytest.approx(ulcer)
    assert row["martin"] == pytest.approx((equity - 1) / ulcer) and row["max_drawdown"] == pytest.approx(min(dd))
    assert row["win_rate"] == 0.5 and row["profit_factor"] == pytest.approx(2) and row["risk_of_ruin"] == pytest.approx((1 / 3) ** 5)
    flat = metrics.performance(series(spark, [0, 0], column="returns"), ["series_id"]).first()
    assert flat["sharpe"] is None and flat["martin"] is None and flat["win_rate"] is None
    m = series(spark, [1, 3, 9, 27]).agg(*[c.alias(n) for n, c in metrics.moments(F.col("value")).items()]).first()
    assert (m["skew"], m["kurtosis"], m["std"]) == pytest.approx((0.892251, -0.902857, 10.246951), abs=1e-5)


def test_transitions(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([0, 0, -1, 1, 0])], "series_id string, pos long, cluster int")
    got = {(r["from"], r["to"]): r["p"] for r in evaluate.transitions(df).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 1}


def test_clusters(spark):
    rng = random.Random(3)
    rows = [(i, [c + rng.random() / 10, -c]) for i, c in enumerate([0.0, 5.0, 10.0] * 20)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    for centers in (cluster.fit(df, 3), cluster.fit(df, 3, "sequential"), cluster.fit(df, 3, "sequential", "dtw")):
        assert sorted(round(c[1]) for c in centers) == [-10, -5, 0]
    got = cluster.assign(df, [[0.0, 0.0], [5.0, -5.0], [10.0, -10.0]])
    assert [r["cluster"] for r in got.orderBy("id").collect()] == [0, 1, 2] * 20
    tie = spark.createDataFrame([([1.0],)], "features array<double>")
    assert cluster.assign(tie, [[0.0], [2.0]]).first()["cluster"] == 0
    with pytest.raises(DataError):
        cluster.fit_sequential(df.limit(2), 3)
    p = spark.createDataFrame([([0.7, 0.2, 0.1],), ([0.5, 0.4, 0.1],), ([0.1, 0.8, 0.1],)], "p array<double>")
    side, sure = cluster.signal(F.col("p"), [0], [1])
    assert [tuple(r) for r in p.select(side, sure).collect()] == [(1, 0.7), (0, pytest.approx(0.1)), (-1, 0.8)]


def test_scorer(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        x = [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i, x, [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]))
    df = spark.createDataFrame(rows, "id long, features array<double>, future array<array<double>>")
    df = df.withColumn("change", scorer.price_change(F.col("future")))
    m = scorer.MovementScorer.fit(df)
    import numpy as np

    t = scorer.target_scores(df).orderBy("id").collect()
    x, y = np.array([r["features"] for r in t]), np.array([r["target"] for r in t])
    assert np.allclose(m.weights, np.linalg.solve(x.T @ x + 0.01 * np.eye(8), x.T @ y))
    s = [r[0] for r in df.select(m.score(F.col("features"))).collect()]
    assert max(map(abs, s)) <= 1 and sum(m.importance().values()) == pytest.approx(1)
    with pytest.raises(DataError):
        scorer.MovementScorer.fit(df.limit(10))


def test_finite(spark):
    with pytest.raises(DataError):
        cleaning.require_finite(series(spark, [1, float("nan")]), "value")
    cleaning.require_finite(series(spark, [1, 2]), "value")
    assert column(cleaning.asinh_scale(series(spark, [2, 2]), "value"), "scaled") == [0, 0]


def test_student_columns(spark):
    from tidelode.functions import student

    rows = [(float(n), t) for n in (1, 2, 3, 10, 49, 1000, 1_000_000) for t in (0.0, 0.5, -2.0, 5.0, 40.0)] + [(5.0, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "n double, t double")
    for n, t, p, q in df.select("n", "t", student.two_sided_column(F.col("t"), F.col("n")), student.quantile_column(0.975, F.col("n"))).collect():
        assert p is None if n is None or t is None else p == pytest.approx(student.two_sided(t, n), rel=1e-7, abs=1e-12)
        assert q is None if n is None else q == pytest.approx(student.quantile(0.975, n), rel=1e-7)


def test_t_intervals(spark):
    stats = [{"cluster": i, "mean": m, "sem": s, "n": n, "std": 0.2, "consistency": c} for i, (m, s, n, c) in enumerate([(0.5, 0.1, 50, 0.9), (-0.4, 0.1, 20, 0.7), (0.1, 0.1, 30, 0.9), (0.5, 0.0, 9, 0.9), (0.5, None, 1, 0.9), (0.9, 0.1, 40, 0.5)])]
    df = spark.createDataFrame(stats, "cluster int, mean double, sem double, n long, std double, consistency double")
    got = {r["cluster"]: r for r in evaluate.with_t_interval(df).collect()}
    for want in evaluate.with_interval(stats):
        r = got[want["cluster"]]
        for k in ("lower", "upper", "p_value"):
            assert r[k] == (want[k] if want[k] is None else pytest.approx(want[k], rel=1e-7)), (want["cluster"], k)
    kept = evaluate.significant_patterns(evaluate.with_t_interval(df)).orderBy(F.desc("score")).collect()
    want = evaluate.select_patterns(evaluate.with_interval(stats))
    assert [(r["cluster"], r["side"]) for r in kept] == [(r["cluster"], r["side"]) for r in want] == [(0, 1), (1, -1)]
    assert [r["score"] for r in kept] == pytest.approx([r["score"] for r in want])
