"""Order-dependent operators over series of any length.

A series is rows (series_id, pos, ...). Nothing here sorts a whole series in one task: positions come
from counts of time buckets, frames of bounded size from chunks with a halo of neighbouring rows,
running totals from totals of chunks. A series that holds most rows is split like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidelode.schema import micros, seconds

SERIES = "series_id"
#: Rows of a series that one task windows over.
CHUNK = 1 << 16


def number_rows(df: DataFrame, *ties: str, ts: str = "ts", bucket: str | int = "1h") -> DataFrame:
    """df with pos: 0, 1, ... in each series by ts, then by the columns of ties.

    A task sorts a bucket of a series; the counts of a series' buckets, one for each hour that has rows, meet in one."""
    width = seconds(bucket) * 1_000_000
    b = df.withColumn("__b", F.floor(micros(F.col(ts)) / F.lit(width)))
    counts = b.groupBy(SERIES, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(SERIES).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(SERIES, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inner = Window.partitionBy(SERIES, "__b").orderBy(ts, *ties)
    rows = b.withColumn("__r", F.row_number().over(inner) - 1)
    return rows.join(counts, [SERIES, "__b"]).withColumn("pos", F.col("__o") + F.col("__r")).drop("__b", "__o", "__r")


def framed(df: DataFrame, columns: dict[str, Callable[[WindowSpec], Column]], before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """df with columns computed over a series in order of pos, from at most so many rows before and after.

    Each function gets the ordered window; rows beyond before and after may or may not be in it."""
    chunk = max(chunk, before, after, 1)
    own = F.expr(f"pos div {chunk}")
    spots = [own]
    if before:
        spots.append(F.when(F.col("pos") % chunk >= chunk - before, own + 1))
    if after:
        spots.append(F.when(F.col("pos") % chunk < after, own - 1))
    spread = df.withColumn("__c", F.explode(F.array_compact(F.array(*spots))) if len(spots) > 1 else own)
    w = Window.partitionBy(SERIES, "__c").orderBy("pos")
    out = spread.withColumns({name: f(w) for name, f in columns.items()})
    return out.where(F.col("__c") == own).drop("__c")


def running(df: DataFrame, name: str, value: Column, kind: str = "sum", chunk: int = CHUNK) -> DataFrame:
    """df with the running sum or max of value over each series, this row included."""
    f = {"sum": F.sum, "max": F.max}[kind]
    c = df.withColumn("__v", value).withColumn("__c", F.expr(f"pos div {chunk}"))
    totals = c.groupBy(SERIES, "__c").agg(f("__v").alias("__t"))
    earlier = Window.partitionBy(SERIES).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(SERIES, "__c", f("__t").over(earlier).alias("__t"))
    inner = Window.partitionBy(SERIES, "__c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("__i", f("__v").over(inner)).join(totals, [SERIES, "__c"])
    total = F.col("__i") + F.coalesce("__t", F.lit(0)) if kind == "sum" else F.greatest("__i", "__t")
    return c.withColumn(name, total).drop("__v", "__c", "__t", "__i")
