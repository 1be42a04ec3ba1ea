"""What the training-data operators share: scratch tables, checked broadcasts, text helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows, and most bytes of them as text, that a side may have to be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session that has none, as in tests, gets a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidelode-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tidelode-{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def delete_at_exit(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_stored(df: DataFrame) -> None:
    """Delete what stored() wrote; nothing may read it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("tidelode-"):
            delete_path(spark, path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows and BROADCAST_BYTES; only the lengths of rows + 1 rows are moved to tell.

    df is cheap to read: a stored table or an aggregate of one."""
    sizes = df.select(F.octet_length(F.struct(*df.columns).cast("string")).alias("b")).limit(rows + 1)
    n, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and total <= BROADCAST_BYTES


def small_or_join(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df


#: A key of more than one in so many rows is hot; there are at most as many hot keys.
HOT_SHARE = 1024


def join_spread(rows: DataFrame, table: DataFrame, by: list[str], values: list[str], n: str, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to table, a stored table of one row for each key, whose n tells how many of rows have it.

    Hot keys come by a broadcast of at most HOT_SHARE rows; their rows, and those with a null key, are dealt
    by the columns of spread, so that no task gets more than its share of one key. In table by and the
    first of values aren't null; rows has no columns of the names that are made here."""
    total, most = table.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    if most * HOT_SHARE <= total and how == "inner":
        return rows.join(table.select(*by, *values), by)
    hot = table.where(F.col(n) * HOT_SHARE > total).select(*by, *[F.col(v).alias(f"hot_{v}") for v in values])
    rows = rows.join(F.broadcast(hot), by, "left")
    own = F.pmod(F.xxhash64(*spread), F.lit(1 << 30)) + 1
    cold_row = F.col(f"hot_{values[0]}").isNull() & ~reduce(Column.__or__, [F.col(c).isNull() for c in by])
    rows = rows.withColumn("salt", F.when(cold_row, 0).otherwise(own).cast("long"))
    # least(n, 0) is 0, but no literal, which would be taken out of the join's keys
    cold = table.where(F.col(n) * HOT_SHARE <= total).select(*by, *values, F.least(F.col(n), F.lit(0)).cast("long").alias("salt"))
    out = rows.join(cold, [*by, "salt"], "left")
    is_hot = F.col(f"hot_{values[0]}").isNotNull()
    out = out.withColumns({v: F.when(is_hot, F.col(f"hot_{v}")).otherwise(F.col(v)) for v in values})
    if how == "inner":
        out = out.where(F.coalesce(values[0], values[0]).isNotNull())
    return out.drop("salt", *[f"hot_{v}" for v in values])


def offsets(sums: DataFrame, keys: list[str], at: str, value: str | list[str], out: str | list[str], group: int = 4096) -> DataFrame:
    """sums with out: the sum of value over the smaller numbers at of its keys; runs of group numbers are summed by themselves.

    Several values, each with an out of its own, are summed in one pass."""
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    g = sums.withColumn("run", F.floor(F.col(at) / group))
    runs = g.groupBy(*keys, "run").agg(*[F.sum(v).alias(f"run_sum_{i}") for i, v in enumerate(values)])
    order = Window.partitionBy(*keys).orderBy("run")
    starts = [(F.sum(f"run_sum_{i}").over(order) - F.col(f"run_sum_{i}")).alias(f"run_start_{i}") for i in range(len(values))]
    runs = runs.select(*keys, "run", *starts)
    inner = Window.partitionBy(*keys, "run").orderBy(at)
    g = g.withColumns({f"within_{i}": F.sum(v).over(inner) - F.col(v) for i, v in enumerate(values)}).alias("g")
    r = runs.alias("r")
    same = F.lit(True)
    for k in [*keys, "run"]:
        same = same & F.col(f"g.{k}").eqNullSafe(F.col(f"r.{k}"))
    found = [(F.col(f"run_start_{i}") + F.col(f"within_{i}")).alias(o) for i, o in enumerate(outs)]
    return g.join(r, same).select(*[f"g.{c}" for c in sums.columns], *found)


def numbered(df: DataFrame, by: list[Column], out: str) -> DataFrame:
    """A stored copy of df with out: 0, 1, ... in order of by; only a row for each partition meets in one task."""
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()), "numbered")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i0"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("i0")).alias("shift"))
    return rows.join(F.broadcast(parts), "part").withColumn(out, F.col("i") + F.col("shift")).drop("part", "i", "shift")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str) -> Column:
    """The text's words, an empty array for null; separators is a regular expression of one or more."""
    return F.coalesce(F.array_remove(F.split(text, separators), ""), F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    """Runs of characters that aren't white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def own_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
