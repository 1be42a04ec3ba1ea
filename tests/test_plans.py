"""Physical plans: columns pruned at the scan, no window over everything, no cartesian product, Python only where meant."""

import pytest
from pyspark.sql import functions as F

from tidelode.operators import cleaning
from tidelode.plans import queries, registry

DIR = "/root/testdata/sf0.001"
PYTHON = {"cross_validation", "wavelet_db2", "wavelet_sym5", "miner_predict", "miner_fixed_signals", "fft_topn", "haar_topn", "fft_wavelet", "pip_three_points", "pip_reduce", "wavelet_reduce", "mvr_reduce", "movement_features", "transform_windows", "dtw_distance", "mpdist_distance", "mpdist_sliding", "miner_evaluate", "miner_signals"}
#: A row for each batch is put in order in one task.
BATCHES = {"label_stability", "density_stability", "bayes_stability", "cusum_score", "histogram_drift", "stability_report", "memory_weights"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in ("kmeans_fit", "sequential_kmeans", "miner_evaluate", "miner_signals")])
def test_plan(spark, name):
    p = plan(registry.QUERIES[name](spark, DIR))
    assert "CartesianProduct" not in p
    assert ("Python" in p or "Pandas" in p or "Arrow" in p) == (name in PYTHON)
    if name not in BATCHES and "Window" in p:
        assert not any("SinglePartition" in line for line in p.splitlines())


def test_scans_read_what_is_needed(spark):
    p = plan(queries.ohlcv_bars(spark, DIR))
    assert "props" not in p and "user_id" not in p
    p = plan(cleaning.date_range(queries._ticks(spark, DIR), "2024-01-05", "2024-01-20").select("event_id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p
    p = plan(queries.lineitem_daily_bars(spark, DIR).where(F.col("series_id") == "A"))
    assert "EqualTo(l_returnflag,A)" in p
