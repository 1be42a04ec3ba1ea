"""Every query of the series engine against its SQL, on the smallest tables."""

import datetime as dt

import __spark_entry__
import duckdb
import pytest

from tidelode.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 5) + 0.0)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in cols] for r in df.collect())
    assert len(rows) > 0 or name == "miner_evaluate"
    if name in registry.ORACLES:
        cur = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert sorted([plain(r[i]) for i in at] for r in cur.fetchall()) == rows


def test_whole_windows_are_checked(spark, duck):
    got = registry.QUERIES["sliding_windows_whole"](spark, DIR).groupBy("series_id", "pos").count().select("count").distinct().collect()
    assert [r[0] for r in got] == [25]
    assert duck.execute(f"select count(distinct i) from ({registry.ORACLES['sliding_windows_whole']})").fetchone()[0] == 25


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
