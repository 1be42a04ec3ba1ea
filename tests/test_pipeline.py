"""The facade, sources and streams on the smallest tables."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelode.operators import cluster, ordered, reducers, windows
from tidelode.plans import miner
from tidelode.schema import DataError
from tidelode.sources import market, models
from tidelode.streaming import online, stability

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    t = spark.read.parquet(f"{DIR}/events.parquet").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    return ordered.number_rows(t, "event_id").select("series_id", "pos", "ts", "value").cache()


@pytest.mark.parametrize("kind", ["PIP", "FFT", "Wavelet", "FFTWavelet", "MVR"])
def test_fit_and_apply(spark, events, tmp_path, kind):
    c = miner.Config(n_clusters=4, n_pivots=8 if kind == "MVR" else 4, reducer_type=kind, evaluator_params={"min_samples": 5})
    m = miner.Miner(c)
    data = events.select("series_id", "pos", "value")
    m.fit(data)
    assert len(m.centers) == 4
    labels = m.predict(data)
    assert labels.where("cluster is null or cluster not between 0 and 3").count() == 0
    m.save(str(tmp_path / "model"))
    again = miner.Miner.load(spark, str(tmp_path / "model"))
    assert again.config == c and (again.long, again.short) == (m.long, m.short)
    one, two = ([tuple(r) for r in x.predict(data).select("series_id", "pos", "cluster").orderBy("series_id", "pos").collect()] for x in (m, again))
    assert one == two
    assert m.evaluate(data).count() > 0
    assert m.signals(data).where("signal not in (-1, 0, 1)").count() == 0


def test_vector_patterns(events):
    c = miner.Config(n_clusters=2, evaluator_type="vector_pattern", evaluator_params={"n_future_vectors": 2, "min_samples": 5}, min_movement=0.01)
    m = miner.Miner(c)
    m.centers = [[0.0] * 4, [1.0] * 4]
    scaled = m._scaled(events.select("series_id", "pos", "value"), True)
    labels = scaled.select("series_id", "pos", (F.col("pos") % 2).cast("int").alias("cluster"))
    from tidelode.operators import evaluate
    from tidelode.operators.scorer import MovementScorer

    pairs = evaluate.window_pairs(labels, scaled.withColumn("value", F.col("scaled")), 2, 0.01, 2.0)
    samples = evaluate.pattern_samples(pairs, 2)
    s = MovementScorer.fit(samples, 5)
    stats = evaluate.with_interval([r.asDict() for r in evaluate.pattern_performance(samples, s).collect()])
    assert len(stats) == 2 and all(0 <= r["p_value"] <= 1 and r["lower"] <= r["mean"] <= r["upper"] for r in stats)
    evaluate.select_patterns(stats)


def test_harness_and_folds(events):
    data = events.select("series_id", "pos", "value")
    out = miner.run_mining_test(data, {"n_clusters": 3, "evaluator_params": {"min_samples": 3}})
    assert out["evaluation"].count() > 0
    rows = miner.cross_validate(miner.Config(n_clusters=2, n_lookback=10, evaluator_params={"min_samples": 2}), data, 2)
    assert [r["fold"] for r in rows] == [0, 1] and set(miner.CV_METRICS) < set(rows[0])


def test_folds_at_once_are_folds_one_by_one(events):
    data = events.where("pos < 150").select("series_id", "pos", "value")
    returns = data.withColumn("returns", (F.col("value") % 7 - 2.5) / 1000)
    centers = [[-1.2, 0.0, 1.2], [1.2, 0.0, -1.2], [-0.7, 1.4, -0.7], [0.7, -1.4, 0.7]]
    c = miner.Config(n_lookback=8, n_pivots=3, n_clusters=4, model_type="sequential", evaluator_params={"min_samples": 2})
    got = {r["fold"]: r for r in miner.cross_validation(c, data, 2, centers, returns).collect()}
    parts = windows.folds(returns, 2)
    for fold in range(2):
        train, test = (parts.where((F.col("fold") == fold) & (F.col("part") == p)) for p in ("train", "test"))
        start = test.groupBy("series_id").agg(F.min("pos").alias("p"))
        test = test.join(start, "series_id").withColumn("pos", F.col("pos") - F.col("p"))
        m = miner.Miner(c)
        m.fit(train.select("series_id", "pos", "value"), train, start=centers, max_iter=0)
        assert m.centers == centers and m.long
        want = m.report(test.select("series_id", "pos", "value"), test).first()
        assert all(got[fold][k] == pytest.approx(want[k]) for k in want.asDict())
    table = {(r["fold"], r["metric"]): r for r in miner.cv_table(miner.cross_validation(c, data, 2, centers, returns)).collect()}
    both = [got[f]["sharpe"] for f in range(2)]
    assert table[0, "sharpe"]["mean"] == pytest.approx(np.mean(both)) and table[1, "sharpe"]["std"] == pytest.approx(np.std(both))


def test_fits_of_folds_are_fits_of_their_rows(spark):
    v = spark.read.parquet(f"{DIR}/embeddings.parquet").select((F.col("vec_id") % 2).cast("int").alias("fold"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("features"))
    got = cluster.fit_folds(v, 3, 2, max_iter=6)
    for f in range(2):
        assert np.allclose(got[f], sorted(cluster.fit_sequential(v.where(F.col("fold") == f), 3, max_iter=6)))
    with pytest.raises(DataError):
        cluster.fit_folds(v, 3, 3)


def test_evaluators_and_reducers_of_ones_own(events):
    from tidelode.operators import evaluate

    def largest(labels, scaled, returns, params):
        n = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("score"))
        return n.where(F.col("score") >= params["least"]).withColumn("side", F.when(F.col("cluster") % 2 == 0, 1).otherwise(-1))

    evaluate.register("largest", largest)
    reducers.register("ends", lambda w, n: F.array(F.element_at(w, 1), F.element_at(w, -1)))
    try:
        c = miner.Config(n_lookback=8, n_pivots=2, n_clusters=2, evaluator_type="largest", reducer_type="ends", evaluator_params={"least": 1})
        assert miner.Config.from_dict(c.to_dict()) == c
        m = miner.Miner(c)
        data = events.where("pos < 60").select("series_id", "pos", "value")
        m.fit(data)
        assert (m.long, m.short) == ([0], [1]) and m.summary()["n_selected"] == 2
        assert m.evaluate(data).where("selected = 0").isEmpty()
    finally:
        del evaluate.CUSTOM["largest"], reducers.CUSTOM["ends"]
    with pytest.raises(DataError):
        miner.Config(evaluator_type="largest")


def test_pairs_that_overlap(spark):
    from tidelode.operators import evaluate

    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 7), ("b", 0, 3), ("a", 1, 4)], "series_id string, cluster int, pos long")
    assert evaluate.require_apart(df, 5) is df
    with pytest.raises(DataError):
        evaluate.require_apart(df, 6)


@pytest.mark.parametrize("bad", [{"n_clusters": 1}, {"wavelet": "no"}, {"reducer_type": "no"}, {"evaluator_params": {"x": 1}}, {"evaluator_params": {"min_samples": 0}}, {"min_movement": 1}, {"unknown": 1}])
def test_bad_configs(bad):
    with pytest.raises(DataError):
        miner.Config.from_dict(bad)


def test_market_sources(spark, tmp_path, monkeypatch):
    rows = "select timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,cast(id as int)) as time, 1.0D * id as open, 2.0D * id as high, 0.5D * id as low, 1.0D + id as close, 0.0D as volume, 'x' as extra from range(600)"
    spark.sql(rows).write.parquet(str(tmp_path / "crypto" / "BTC.parquet"))
    monkeypatch.setenv("DATA_PATH", str(tmp_path))
    assert market.resolve(spark, "btc").endswith("crypto/BTC.parquet")
    df = market.load(spark, "btc", "1h")
    assert df.count() == 10 and df.orderBy(F.desc("pos")).first()["returns"] == 0
    assert df.where("volume > 0").count() > 0
    assert market.load(spark, "btc", "1h", start="2024-01-01 05:00").count() == 5
    assert market.load(spark, "btc", "1h", legacy=True).count() == 10
    with pytest.raises(FileNotFoundError):
        market.resolve(spark, "eth")
    with pytest.raises(FileNotFoundError):
        market.resolve(spark, "btc", root=str(tmp_path / "none"))
    monkeypatch.delenv("DATA_PATH")
    with pytest.raises(DataError):
        market.resolve(spark, "btc")
    with pytest.raises(DataError):
        market.to_raw(spark.range(1), "a")
    with pytest.raises(DataError):
        market.from_prices(spark, [1, float("inf")])
    assert market.from_prices(spark, [1, 2]).count() == 2
    (tmp_path / "x.csv").write_text("close\n1.5\n2\n")
    assert market.read_csv(spark, str(tmp_path / "x.csv"), "close double").count() == 2


def test_many_symbols_are_one_scan(spark, tmp_path):
    bar = "timestamp_ntz'2024-01-01' as time, cast({0} as {1}) as open, 2.0D as high, 0.5D as low, 1.0D as close, 0.0D as volume"
    for sub, name, value in (("daily", "AAA", 1), ("crypto", "AAA", 9), ("crypto", "B+C^D E", 2), ("MT5", "X", 3), ("misc", "Y", 4)):
        spark.sql("select " + bar.format(value, "double")).coalesce(1).write.parquet(str(tmp_path / sub / f"{name}.parquet"))
    (tmp_path / "daily" / "OTHER.parquet").mkdir()
    root = str(tmp_path)
    assert market.find(spark, ["x", "aaa", "X"], root=root) == {"X": f"{root}/MT5/X.parquet", "AAA": f"{root}/daily/AAA.parquet"}
    df = market.read_raw(spark, ["aaa", "b+c^d e", "x"], root=root)
    assert {r["series_id"]: r["open"] for r in df.collect()} == {"AAA": 1, "B+C^D E": 2, "X": 3}
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in p and p.count("FileScan") == 1
    assert len(df.inputFiles()) == 3 and not any("crypto/AAA" in f or "/Y." in f for f in df.inputFiles())
    with pytest.raises(FileNotFoundError):
        market.read_raw(spark, ["x", "none"], root=root)
    with pytest.raises(FileNotFoundError):
        market.read_raw(spark, ["x"], root=root, legacy=True)
    assert market.read_raw(spark, ["y"], root=root, subpath="misc").count() == 1
    spark.sql("select " + bar.format(7, "int")).write.parquet(str(tmp_path / "misc" / "INT.parquet"))
    assert sorted(r["open"] for r in market.read_raw(spark, ["int", "y"], root=root).collect()) == [4.0, 7.0]
    assert market.load(spark, ["y", "x"], "1D", root=root).select("series_id").distinct().count() == 2


def test_models_and_reports(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        models.load(spark, str(tmp_path / "none"))
    with pytest.raises(DataError):
        models.validate({})
    assert models.without_data({"temp_x": 1, "training_data": 2, "a": 3}) == {"a": 3}
    models.write_report(spark.createDataFrame([(1.23456, None)], "a double, b double"), str(tmp_path / "report"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a: 1.2346", "b: null"]
    models.setup_logging(False, str(tmp_path / "log")).info("hello")
    assert "hello" in (tmp_path / "log").read_text()


def test_detectors_agree_with_batches(spark):
    v = spark.read.parquet(f"{DIR}/embeddings.parquet").select((F.col("vec_id") % 5).cast("int").alias("batch"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("features"))
    want = {r["batch"]: r.asDict() for r in stability.report(v, 10).collect()}
    d = online.Detectors(10)
    for i, b in enumerate(online.batches(spark, v)):
        got = d.update(b)
        for k in ("change", "distribution", "density", "bayes", "online", "overall"):
            assert got[k] == pytest.approx(want[i][k], abs=1e-6), (i, k)


def test_adaptive_centers_by_stream(spark, tmp_path):
    v = spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    v.repartition(3).write.parquet(str(tmp_path / "in"))
    kept, seen = [], []
    a = online.AdaptiveCenters(cluster.fit_kmeans(v, 3), 0.5, lambda n, c: kept.append(json.dumps(c)))
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    online.adapt_stream(stream, a, lambda df, i: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == v.count() and len(kept) == len(seen) == a.version
    assert np.isfinite(a.centers).all()


def test_bars_by_stream(spark, events, tmp_path):
    t = events.select("series_id", "ts", "value")
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = online.stream_bars(stream, "1 hour").writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    hours = t.select("series_id", F.date_trunc("hour", "ts")).distinct().count()
    assert spark.table("hourly").count() == hours
    assert spark.table("hourly").agg(F.sum("volume")).first()[0] == t.count()


def test_movements_by_stream(spark, events, tmp_path):
    data = events.where("pos < 60").select("series_id", "pos", "value")
    want = {(r[0], r[1]): r[2] for r in reducers.movement_vectors(windows.sliding(data, 12), 8, trend_window=5).collect()}
    for cut in ("pos < 20", "pos >= 20 and pos < 45", "pos >= 45"):
        data.where(cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files come in order of their time
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = online.stream_movements(stream, 12, 8, trend_window=5).writeStream.format("memory").queryName("moves").outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r[0], r[1]): r[2] for r in spark.table("moves").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9)
