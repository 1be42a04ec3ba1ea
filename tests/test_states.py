"""What outlives a driver: versions of models, centers and counts of streams that are stopped and started again."""

import pytest
from pyspark.sql import functions as F

from tidelode.operators import evaluate
from tidelode.plans.stream_queries import keyed_state
from tidelode.schema import DataError
from tidelode.sources import models
from tidelode.sources.states import States
from tidelode.streaming import online, transitions

DIR = "/root/testdata/sf0.001"
STATE = {"config": {"a": 1}, "centers": [[1.0]], "long": [0], "short": []}


def test_states(spark, tmp_path):
    for path in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        s = States(spark, path)
        assert s.versions() == [] and s.latest() is None
        s.put(3, {"x": [1, 2.5], "é": None})
        s.put(3, {"x": 2})
        assert s.append({"y": 1}) == 4 and s.versions() == [3, 4]
        assert s.get(3) == {"x": 2} and s.latest() == (4, {"y": 1}) and s.latest(before=4) == (3, {"x": 2}) and s.latest(before=3) is None
        assert not s._publish(4, {"other": 1}, overwrite=False) and s.get(4) == {"y": 1}
        with pytest.raises(FileNotFoundError):
            s.get(9)


def test_model_versions(spark, tmp_path, monkeypatch):
    path, table = str(tmp_path / "model"), spark.range(5)
    assert models.save(spark, STATE, path, {"t": table}) == 1
    with monkeypatch.context() as m:  # a writer that dies between tables and manifest
        m.setattr(States, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            models.save(spark, STATE | {"long": [7]}, path, {"t": table.limit(2)})
    assert models.versions(spark, path) == [1]
    assert models.load(spark, path)["long"] == [0] and models.load_table(spark, path, "t").count() == 5
    assert models.save(spark, STATE | {"long": [2]}, path, {"t": table.limit(3)}) == 2
    assert models.get_state(spark, path, "long") == [2] and models.get_state(spark, path, "long", 1) == [0]
    assert models.load_table(spark, path, "t").count() == 3 and models.load_table(spark, path, "t", 1).count() == 5
    assert models.set_state(spark, path, short=[5]) == 3
    assert models.load(spark, path)["short"] == [5] and models.load_table(spark, path, "t").count() == 3
    with pytest.raises(DataError):
        models.get_state(spark, path, "none")
    with pytest.raises(FileNotFoundError):
        models.load_table(spark, path, "none")
    place = models.get_state(spark, path, "tables")["t"]["path"]
    spark.range(3, 6).write.mode("overwrite").parquet(f"{path}/{place}")
    with pytest.raises(DataError):
        models.load_table(spark, path, "t")


def features(spark):
    return spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))


def test_adaptive_centers_go_on_after_a_restart(spark, tmp_path):
    v = features(spark)
    parts = [v.where(F.col("vec_id") % 3 == k) for k in range(3)]
    first = [list(r[0]) for r in v.where("vec_id < 3").orderBy("vec_id").select("features").collect()]
    whole = online.AdaptiveCenters(first, 0.5)
    for p in parts:
        whole.step(p)
    folder = str(tmp_path / "in")
    for k, p in enumerate(parts):  # a query for each batch: the stream stops and starts again
        p.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(v.schema).parquet(folder)
        a = online.AdaptiveCenters(first if k == 0 else [[0.0] * 64] * 3, 0.5, states=States(spark, str(tmp_path / "states")))
        online.adapt_stream(stream, a, lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}"), str(tmp_path / "c")).awaitTermination()
    assert a.version == 3
    assert all(x == pytest.approx(y, rel=1e-9) for x, y in zip(a.centers, whole.centers, strict=True))
    assert spark.read.parquet(f"{tmp_path}/out").count() == v.count()
    # a batch that comes again has its first labels and leaves the same centers
    again = online.AdaptiveCenters(first, 0.5, states=States(spark, str(tmp_path / "states")))
    labels = {r["vec_id"]: r["cluster"] for r in again.step(parts[1], number=1).collect()}
    assert labels == {r["vec_id"]: r["cluster"] for r in spark.read.parquet(f"{tmp_path}/out/batch=1").collect()}
    assert again.states.versions() == [-1, 0, 1, 2]
    again.step(parts[2], number=2)
    assert all(x == pytest.approx(y, rel=1e-9) for x, y in zip(again.centers, whole.centers, strict=True))
    with pytest.raises(DataError):
        again.step(parts[0])


def test_transitions_by_stream(spark, tmp_path):
    rows = [("a", i, (i * i // 7) % 3 if i % 11 else None) for i in range(200)] + [("b", i, i % 4 - 1) for i in range(0, 400, 3)] + [("c", 5, 1)]
    df = spark.createDataFrame(rows, "series_id string, pos long, cluster int")
    folder = str(tmp_path / "in")
    for k, cut in enumerate(("pos < 60", "pos >= 60 and pos < 130", "pos >= 120", "pos < 0")):  # some rows come twice
        df.where(cut).repartition(2).write.mode("append").parquet(folder)
        with keyed_state(spark):
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(folder)
            transitions.keep_updates(transitions.stream_transitions(stream, chunk=50), f"{tmp_path}/updates", f"{tmp_path}/c").awaitTermination()
        if k == 0:
            assert transitions.transition_table(spark, f"{tmp_path}/updates").agg(F.sum("n")).first()[0] > 0
    want = {(r["from"], r["to"]): (r["n"], r["p"]) for r in evaluate.transitions(df).collect()}
    got = {(r["from"], r["to"]): (r["n"], r["p"]) for r in transitions.transition_table(spark, f"{tmp_path}/updates").collect()}
    assert got == {k: (n, pytest.approx(p)) for k, (n, p) in want.items()}
