"""Queries of the sources: files written from the driver's tables and read back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelode.plans import queries
from tidelode.plans.queries import SERIES, r6, s6
from tidelode.plans.registry import query
from tidelode.sources import market
from tidelode.sources.scratch import folder

_TYPES = "SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)"


@query(
    "market_scan",
    f"""WITH t AS ({_TYPES})
SELECT upper(event_type) AS series_id, count(*) AS n, min(ts)::TIMESTAMP AS first, max(ts)::TIMESTAMP AS last, {s6("sum(value + CASE WHEN k = 2 THEN 1 ELSE 0 END)")} AS close, {s6("max(value + 2)")} AS high
FROM events JOIN t USING (event_type) WHERE k < (SELECT max(k) FROM t) GROUP BY 1""",
)
def market_scan(spark: SparkSession, d: str) -> DataFrame:
    """A market of a symbol for each event type, all but the last asked for. The second lies in two subfolders, of which the first counts."""
    ticks = queries._ticks(spark, d)
    symbols = [r[0] for r in ticks.select(SERIES).distinct().orderBy(SERIES).collect()]  # a row for each event type
    root = folder(spark, "market")
    for k, symbol in enumerate(symbols):
        value = F.col("value") + (1 if k == 1 else 0)
        prices = {"open": F.col("value"), "high": F.col("value") + 2, "low": F.col("value") - 1, "close": value, "volume": F.lit(1.0)}
        rows = ticks.where(F.col(SERIES) == symbol).select(F.col("ts").alias("time"), *[c.alias(n) for n, c in prices.items()], F.lit("x").alias("more"))
        rows.write.parquet(f"{root}/{'daily' if k % 2 else 'forex'}/{symbol.upper()}.parquet")
        if k == 1:
            rows.withColumn("close", F.lit(0.0)).write.parquet(f"{root}/crypto/{symbol.upper()}.parquet")
    bars = market.read_raw(spark, symbols[:-1], root=root)
    return bars.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), r6(F.sum("close")).alias("close"), r6(F.max("high")).alias("high"))
