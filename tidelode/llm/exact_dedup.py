"""Exact dedup: a persistent digest index, bucketed and sorted by digest, and a sort-merge anti-join.

The index is a bucketed table of the texts seen so far, which another session may open again. A new batch is reduced to one row per digest
(partial aggregation takes hot texts down before any shuffle), joined against the index by a sort-merge
anti-join whose index side needs no exchange, and what is new is appended; so are the counts of what
isn't. Texts that are hot in the batch get their verdict by a broadcast.

Cases: null text counts as empty; all empty texts are equal. Rows with the same id and text are
repeats of one row: they count in group_size, and exactly one of them can be kept. A null id is
smaller than no other id (it stays only if every id of its group is null). An empty batch adds
nothing. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, delete_at_exit, join_spread, scratch_path, shared_dir, stored

_INDEX = "digest binary, keep_id long, n_rows long, batch string, seq long, brought boolean"
_MADE_WITH = "_buckets="


def digest_of(text: Column) -> Column:
    """32 bytes: SHA-256 of the text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256))


class DigestIndex:
    """Persistent table (digest, keep_id, n_rows, batch, seq, brought), bucketed and sorted by digest.

    name: a table of the session's catalog, with its files under path (the shared folder if none is
    given). If neither table nor files are there it is made, with buckets of them (default: as many as shuffle
    partitions); else it keeps the number that it was made with, whatever the session or the caller says.
    Each batch has a row for each of its texts; brought marks the batch that the text came with, and keep_id
    is that batch's. seq numbers the batches."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name, self.path = spark, name, path or f"{shared_dir(spark)}/{name}"
        self.buckets = self._made_with() or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} ({_INDEX}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
            self._folder().create(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_MADE_WITH}{self.buckets}")).close()

    def _folder(self):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _made_with(self) -> int | None:
        """The buckets of an index that is there, by the name of an empty file that readers pass over."""
        found = self._folder().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_MADE_WITH}*")) or []
        return next((int(f.getPath().getName().removeprefix(_MADE_WITH)) for f in found), None)

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def _brought(self) -> DataFrame:
        return self.spark.table(self.name).where("brought")

    def _seq(self, batch: str) -> int:
        """The batch's number: that which it has, else the next."""
        own, most = self.spark.table(self.name).agg(F.max(F.when(F.col("batch") == batch, F.col("seq"))), F.max("seq")).first()
        return own if own is not None else (most or 0) + 1

    def table(self, upto: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """(digest, keep_id, n_rows, batch): a row for each text (of those in of), n_rows over all batches (up to that number)."""
        rows = self.spark.table(self.name)
        if upto is not None:
            rows = rows.where(F.col("seq") <= upto)
        if of is not None:
            rows = of.select("digest").hint("merge").join(rows, "digest")
        first = lambda c: F.max(F.when(F.col("brought"), F.col(c))).alias(c)
        return rows.groupBy("digest").agg(first("keep_id"), F.sum("n_rows").alias("n_rows"), first("batch"))

    def add(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """rows: (id, digest, n), n equal rows each. Appends a row for each text and returns the texts that are new.

        What a batch of this name has appended before, whole or in part, isn't appended again."""
        groups = rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.sum("n").alias("n_rows"))
        if batch is not None:
            there = self.spark.table(self.name).where(F.col("batch") == batch).select("digest")
            groups = groups.hint("merge").join(there, "digest", "left_anti")
        groups = stored(groups, "groups")
        fresh = stored(groups.hint("merge").join(self._brought(), "digest", "left_anti"), "fresh")
        again = groups.hint("merge").join(fresh.select("digest"), "digest", "left_anti")
        batch = batch or uuid.uuid4().hex
        marked = fresh.withColumn("brought", F.lit(True)).unionByName(again.withColumn("brought", F.lit(False)))
        marked = marked.select("digest", "keep_id", "n_rows", F.lit(batch).alias("batch"), F.lit(self._seq(batch)).cast("long").alias("seq"), "brought")
        if not groups.isEmpty():
            self._append(marked)
        return fresh

    def forget(self) -> None:
        """Drop the catalog's entry; the files go with the driver's JVM."""
        delete_at_exit(self.spark, self.path)
        self.spark.sql(f"DROP TABLE {self.name}")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n): one row per distinct id and text, n the times it occurs."""
    return (
        df.select(F.col(id_col).cast("long").alias("id"), digest_of(F.col(text_col)).alias("digest"))
        .groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))
    )


def dedup(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Verdicts on df, whose new texts go into the index (if none is given, a new one that goes with the driver's JVM).

    Returns a row for each of df's: id_col, keep_id, group_size (rows of the text in all batches up to this), kept,
    text_sha256. Only rows of a batch that brought their text can be kept. batch names df: dedup of the same
    rows under the same name, as after a lost driver, appends nothing twice and has the same answers."""
    spark, own = df.sparkSession, index is None
    index = index or DigestIndex(spark, f"tidelode_digests_{uuid.uuid4().hex}", path=scratch_path(spark, "digests"))
    rows = stored(digests(df, id_col, text_col), "digests")
    name = batch or uuid.uuid4().hex
    index.add(rows, name)
    here = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("m"))
    said = index.table(index._seq(name), here).select("digest", "n_rows", "keep_id", (F.col("batch") == name).alias("new"))
    said = stored(here.hint("merge").join(said, "digest"), "said")
    if own:
        index.forget()
    each = join_spread(rows, said, ["digest"], ["n_rows", "keep_id", "new"], "m", ["id", "digest"])
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n_rows").alias("group_size"),
        (F.col("new") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
