"""How often a label follows another, counted on a stream with keyed state.

State is kept by series and chunk of positions, so that a series that holds most rows is many keys: the first
and last label of the chunk, and a map of counts by (from, to). What joins two chunks, the last label of one and the
first of the next that has any, is made up when the counts are read. Labels of a chunk come in order of
pos from batch to batch (in any order inside a batch); a row whose pos isn't after the last one's was seen
before and changes nothing. Null and -1 are no labels.

Updates of a batch are written under its number, in place of what a failed attempt of it left; the latest
update of each count is its value. A stream that is stopped and started again goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelode.operators.ordered import CHUNK, SERIES

_OUT = f"{SERIES} string, chunk long, from int, to int, n long"


class _Counts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "first int, last int, pos long")
        self.counts = handle.getMapState("counts", "from int, to int", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, at = self.ends.get() if self.ends.exists() else (None, None, None)
        new = pd.concat(list(rows)).drop_duplicates("pos").sort_values("pos")
        if at is not None:
            new = new[new["pos"] > at]
        if new.empty:
            return
        labels = new["cluster"].to_numpy(np.int64)
        begins = first is None
        froms = labels[:-1] if begins else np.concatenate(([last], labels[:-1]))
        pairs, n = np.unique(np.column_stack([froms, labels[1:] if begins else labels]), axis=0, return_counts=True)
        out = []
        for (a, b), more in zip(pairs.tolist(), n.tolist(), strict=True):
            total = more + (self.counts.getValue((a, b))[0] if self.counts.containsKey((a, b)) else 0)
            self.counts.updateValue((a, b), (total,))
            out.append((*key, a, b, total))
        first = int(labels[0]) if begins else first
        self.ends.update((first, int(labels[-1]), int(new["pos"].iloc[-1])))
        # the chunk's ends: from nothing to the first label, from the last to nothing
        out += [(*key, None, first, 0), (*key, int(labels[-1]), None, int(new["pos"].iloc[-1]))]
        frame = pd.DataFrame(out, columns=[SERIES, "chunk", "from", "to", "n"])
        yield frame.astype({"from": "Int32", "to": "Int32"})

    def close(self) -> None:
        pass


def stream_transitions(labels: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Updates of counts (series_id, chunk, from, to, n) of a stream (series_id, pos, cluster).

    A null from is a chunk's beginning, a null to its end so far (n: the position)."""
    known = labels.where("cluster is not null and cluster <> -1").select(SERIES, F.expr(f"pos div {chunk}").alias("chunk"), "pos", F.col("cluster").cast("int").alias("cluster"))
    return known.groupBy(SERIES, "chunk").transformWithStateInPandas(_Counts(), outputStructType=_OUT, outputMode="Update", timeMode="None")


def keep_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes each batch's updates under path, for all rows that are there."""
    keep = lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")
    return updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transition_table(spark: SparkSession, path: str) -> DataFrame:
    """(from, to, n, p) by the latest updates: how often a label followed another; rows add up to 1."""
    rows = spark.read.schema(_OUT + ", batch long").parquet(path)
    inside = rows.where("from is not null and to is not null").groupBy(SERIES, "chunk", "from", "to").agg(F.max_by("n", "batch").alias("n"))
    first = F.max_by(F.when(F.col("from").isNull(), F.col("to")), F.when(F.col("from").isNull(), F.col("batch")))
    last = F.max_by(F.when(F.col("to").isNull(), F.col("from")), F.when(F.col("to").isNull(), F.col("batch")))
    ends = rows.where("from is null or to is null").groupBy(SERIES, "chunk").agg(first.alias("first"), last.alias("last"))
    later = Window.partitionBy(SERIES).orderBy("chunk")  # a row for each chunk
    joints = ends.select(F.col("last").alias("from"), F.lead("first").over(later).alias("to"), F.lit(1).cast("long").alias("n")).where("to is not null")
    pairs = inside.select("from", "to", "n").unionByName(joints).groupBy("from", "to").agg(F.sum("n").alias("n"))
    totals = pairs.groupBy("from").agg(F.sum("n").alias("__t"))
    return pairs.join(totals, "from").select("from", "to", "n", (F.col("n") / F.col("__t")).alias("p"))
