"""Queries of the streaming operators: streams over the driver's tables, stopped and started again, and their SQL."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.plans import queries
from tidelode.plans.queries import SERIES, r6, s6
from tidelode.plans.registry import ORACLES, query
from tidelode.sources.scratch import folder
from tidelode.sources.states import States
from tidelode.streaming import online, transitions

@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs RocksDB's store while a query starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


@query("transition_stream", ORACLES["transition_matrix"])
def transition_stream(spark: SparkSession, d: str) -> DataFrame:
    """Labels come in three stretches of time; after each the stream is stopped, and goes on from its checkpoint."""
    labels = queries._labels(spark, d).select(SERIES, "pos", F.col("cluster").cast("int").alias("cluster"))
    last = labels.groupBy(SERIES).agg(F.max("pos").alias("last"))
    staged = labels.join(last, SERIES).withColumn("stretch", F.expr("least(pos * 3 div (last + 1), 2)")).drop("last")
    work = folder(spark, "transitions")
    staged.write.partitionBy("stretch").parquet(f"{work}/staged")
    staged = spark.read.parquet(f"{work}/staged")
    for k in range(3):
        staged.where(F.col("stretch") == k).drop("stretch").write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(labels.schema).parquet(f"{work}/in")
        with keyed_state(spark):
            transitions.keep_updates(transitions.stream_transitions(stream, chunk=512), f"{work}/updates", f"{work}/checkpoint").awaitTermination()
    return transitions.transition_table(spark, f"{work}/updates").select("from", "to", "n", r6(F.col("p")).alias("p"))


RATE, K, BINS = 0.5, 4, 20


def _adaptive_sql(steps: int) -> str:
    """The steps one after another: labels, the five detectors, the rate, and the centers after it."""
    parts = [
        "v AS (SELECT vec_id, vec_id % 3 AS batch, embedding::DOUBLE[] AS x FROM embeddings)",
        f"c0 AS (SELECT vec_id::INT AS cluster, x AS c FROM v WHERE vec_id < {K})",
        f"s0 AS (SELECT range AS cluster, NULL::DOUBLE AS share, {1 / K}::DOUBLE AS post FROM range(0, {K}))",
        "m AS (SELECT batch, avg(list_aggregate(x, 'avg')) AS m, min(list_aggregate(x, 'avg')) AS lo, max(list_aggregate(x, 'avg')) AS hi FROM v GROUP BY 1)",
        f"""hist AS (SELECT batch, k, count(b) / any_value(t)::DOUBLE AS p FROM (SELECT batch, count(*) AS t FROM v GROUP BY 1) CROSS JOIN range(0, {BINS}) r(k)
  LEFT JOIN (SELECT batch AS b, greatest(least(floor((list_aggregate(x, 'avg') - (SELECT lo FROM m WHERE batch = 0)) / (SELECT (hi - lo) / {BINS} FROM m WHERE batch = 0)), {BINS - 1}), 0)::BIGINT AS bin FROM v) ON b = batch AND bin = k GROUP BY 1, 2)""",
        "js AS (SELECT h.batch, 1 - sqrt(greatest(sum((CASE WHEN h.p > 0 THEN h.p * ln(h.p / ((h.p + o.p) / 2)) ELSE 0 END + CASE WHEN o.p > 0 THEN o.p * ln(o.p / ((h.p + o.p) / 2)) ELSE 0 END) / 2), 0)) AS online FROM hist h JOIN hist o ON o.batch = h.batch - 1 AND o.k = h.k GROUP BY 1)",
        "z AS (SELECT batch, CASE WHEN batch < 2 THEN 0 ELSE (m - (SELECT avg(m) FROM m p WHERE p.batch < m.batch)) / (SELECT stddev_pop(m) FROM m p WHERE p.batch < m.batch) END AS z FROM m)",
        "cu AS (SELECT batch, least(greatest(greatest(z, 0), greatest(-z, 0)) / 2, 1) AS change FROM z)",
    ]
    for i in range(steps):
        parts += [
            f"l{i} AS (SELECT vec_id, any_value(x) AS x, arg_min(cluster, (list_distance(x, c), cluster)) AS cluster FROM v, c{i} WHERE batch = {i} GROUP BY 1)",
            f"w{i} AS (SELECT cluster, list(a ORDER BY i) AS mean FROM (SELECT cluster, i, avg(e) AS a FROM (SELECT cluster, unnest(x) AS e, unnest(range(0, len(x))) AS i FROM l{i}) GROUP BY ALL) GROUP BY 1)",
            f"r{i} AS (SELECT cluster, count(*) AS n, avg(list_distance(x, mean)) AS radius FROM l{i} JOIN w{i} USING (cluster) GROUP BY 1)",
            f"""p{i} AS (SELECT s.cluster, coalesce(n, 0) / (SELECT count(*) FROM l{i})::DOUBLE AS share, s.share AS old, s.post AS prior,
  s.post * (coalesce(exp(-radius * radius / 2) / sqrt(2 * pi()), 0) + 1e-10) AS raw FROM s{i} s LEFT JOIN r{i} r ON r.cluster = s.cluster)""",
            f"s{i + 1} AS (SELECT cluster, share, raw / (SELECT sum(raw) FROM p{i}) AS post FROM p{i})",
            f"d{i} AS (SELECT coalesce(avg(1 / (radius + 1e-10)) FILTER (n >= 2), 0) AS density FROM r{i})",
            f"""o{i} AS (SELECT {RATE} * (1 - least(greatest(0.25 * (1 - change) + 0.25 * {f"(SELECT 1 - avg(abs(share - old)) FROM p{i})" if i else "1"} + 0.15 * {f"(SELECT online FROM js WHERE batch = {i})" if i > 1 else "1"}
  + 0.2 * {f"(1 - abs((SELECT density FROM d{i}) - (SELECT density FROM d{i - 1})))" if i else "1"} + 0.15 * (SELECT 1 - avg(abs(s.post - p.prior)) FROM s{i + 1} s JOIN p{i} p USING (cluster)), 0), 1)) * (1 + change) AS rate FROM cu WHERE batch = {i})""",
            f"c{i + 1} AS (SELECT cluster, CASE WHEN mean IS NULL THEN c ELSE list_transform(range(1, len(c) + 1), lambda j: (1 - rate) * c[j] + rate * mean[j]) END AS c FROM c{i} LEFT JOIN w{i} USING (cluster), o{i})",
        ]
    shown = " UNION ALL ".join(f"SELECT {i} AS batch, cluster, unnest(c) AS x, unnest(range(0, len(c)))::INT AS i FROM c{i + 1}" for i in range(steps))
    return f"WITH {', '.join(parts)} SELECT batch::INT AS batch, cluster::INT AS cluster, i, {s6('x')} AS x FROM ({shown})"


@query("adaptive_centers", _adaptive_sql(3))
def adaptive_centers(spark: SparkSession, d: str) -> DataFrame:
    """Centers after each of three batches; each batch comes twice, and every time to an object that knows the states alone."""
    vectors = queries._vectors(spark, d).select("vec_id", "features")
    states = States(spark, folder(spark, "centers"))
    first = queries._centers(spark, d)
    for number in range(3):
        for begin in (first, [[0.0] * len(c) for c in first]):
            online.AdaptiveCenters(begin, RATE, states=states).step(vectors.where(F.col("vec_id") % 3 == number), number=number)
    rows = [(number, c, center) for number in range(3) for c, center in enumerate(states.get(number)["centers"])]
    out = spark.createDataFrame(rows, "batch int, cluster int, center array<double>")  # K rows for each batch
    return out.select("batch", "cluster", F.posexplode("center").alias("i", "x")).withColumn("x", r6(F.col("x")))
