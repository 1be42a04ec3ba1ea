"""The mix as tables of its own: no plan holds the draw, the places of documents and the texts at once."""

from pyspark.sql import functions as F

from tidelode.llm import common, mixing

DIR = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_plans_of_the_mix_stay_small(spark, monkeypatch):
    seen, keep = {}, mixing.stored

    def look(df, name):
        seen[name] = exchanges(df)
        return keep(df, name)

    monkeypatch.setattr(mixing, "stored", look)
    mix = mixing.Mix(spark.read.parquet(f"{DIR}/documents.parquet"))
    seen |= {"texts": exchanges(mix.texts()), "taken": exchanges(mix.taken())}
    assert max(seen.values()) <= 14, seen  # 22 and more where all was one plan


def test_offsets_of_several_values_are_those_of_each(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), (F.col("id") * 7 % 11).alias("x"), (F.col("id") * 5 % 13).alias("y"))
    both = common.offsets(rows, ["k"], "at", ["x", "y"], ["a", "b"], group=16)
    assert both.columns == ["k", "at", "x", "y", "a", "b"]
    assert sorted(both.select("k", "at", "a").collect()) == sorted(common.offsets(rows, ["k"], "at", "x", "a", group=16).select("k", "at", "a").collect())
    sums = [0] * 3
    for k, _, _, y, _, b in sorted(both.collect(), key=lambda r: r["at"]):
        assert b == sums[k]
        sums[k] += y
