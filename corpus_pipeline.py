"""A corpus pipeline over documents: quality, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the
columns of documents; the last returns the mix itself: texts of equal length, in shards.

Cases, for every stage: null and empty texts are documents (the classifier judges them like any other,
line dedup keeps them, they link with nothing, contain nothing and add nothing to the mix); null ids and
sources are allowed; of rows of equal id and text near_duplicates keeps one, the other stages treat
them alike; no rows give no rows. Columns of other names pass through, but for the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from tidelode.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do documents of which nothing is left. n_chars follows."""
    out, _, deleted = line_dedup.dedup_lines(docs)
    out = out.where((F.col(deleted) == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col(deleted) == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of 5 words, similarity 0.8 or more."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(shard, slot, source, doc_ids, text): blocks of 256 words and the documents they are of, in drawn order."""
    return mixing.Mix(docs).texts()


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: The classifier and the mix can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
