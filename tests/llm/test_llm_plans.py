"""The native operators have no Python, and nothing has a cartesian product."""

import __spark_entry__
import pytest

DIR = "/root/testdata/sf0.001"
NATIVE = ["op1_decontaminate", "op3_url_filter", "op4_line_dedup", "op5_chat_format", "op9_mixing", "op10_exact_dedup"]


@pytest.mark.parametrize("name", NATIVE)
def test_native(spark, name, monkeypatch):
    from pyspark.sql import readwriter

    plans = []
    keep = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for kind in ("parquet", "saveAsTable"):
        f = getattr(readwriter.DataFrameWriter, kind)
        monkeypatch.setattr(readwriter.DataFrameWriter, kind, lambda self, *a, f=f, **b: (keep(self._df), f(self, *a, **b))[1])
    keep(__spark_entry__.queries()[name](spark, DIR))
    assert plans
    for p in plans:
        assert not any(x in p for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))
