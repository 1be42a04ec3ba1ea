"""Holding periods: of signals closer than a hold, the first is taken and the next hold bars are held.

The choice is sequential in a series and side, but all that a chunk of positions has to know of what
came before is the first place it may take, one of hold + 1. So each chunk is a map from that place to
the next chunk's; maps of runs of chunks are composed, the composed maps are followed in order, and
then every chunk takes its signals by itself. No task has more than a chunk's positions, a run's maps,
or a map for about a million positions of a series.

Cases: repeated positions count once; positions needn't be dense; no signals give no rows; keys aren't
null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelode.operators.ordered import SERIES
from tidelode.schema import let

#: Places of a chunk, and chunks of a run.
CHUNK = 1024


def _enter(acc: Column, c: Column, name: str) -> Column:
    """The place at which cell c is entered after acc (at, place); 0 if its forerunner is absent."""
    return F.when(c[name] == acc["at"] + 1, acc["place"]).otherwise(0)


def _start(before: Column, place: Column) -> list[Column]:
    return [before.cast("long").alias("at"), place.cast("int").alias("place")]


def _through(cells: Column, name: str, before: Column, place: Column) -> Column:
    """(at, place) after the cells (name, m) in order, from a place after the cell numbered before."""
    step = lambda acc, c: F.struct(c[name].cast("long").alias("at"), F.get(c["m"], _enter(acc, c, name)).alias("place"))
    return F.aggregate(cells, F.struct(*_start(before, place)), step)


def _entered(cells: Column, name: str, before: Column, place: Column) -> Column:
    """Each cell's number with the place it is entered at."""

    def step(acc: Column, c: Column) -> Column:
        at = _enter(acc, c, name)
        mine = F.array(F.struct(c[name].cast("long").alias("at"), at.alias("place")))
        return F.struct(c[name].cast("long").alias("at"), F.get(c["m"], at).alias("place"), F.concat(acc["taken"], mine).alias("taken"))

    return F.aggregate(cells, F.struct(*_start(before, place), F.expr("cast(array() as array<struct<at: bigint, place: int>>)").alias("taken")), step)["taken"]


def _map(positions: Column, start: Column, k: int, hold: int) -> Column:
    """Of a chunk of k places with signals at positions: for each place that may be the first to take, the next chunk's.

    The next signal at or after every place is looked up, so that a place costs as many steps as the chunk has room
    for signals, whatever the hold: k steps for all places together."""
    before = F.concat(F.array(start - 1), F.slice(positions, 1, F.size(positions) - 1))
    ahead = F.flatten(F.zip_with(positions, before, lambda p, q: F.array_repeat((p - start).cast("int"), (p - q).cast("int"))))
    steps = F.sequence(F.lit(0), F.lit(k // (hold + 1)))

    def last(of: Column, place: Column) -> Column:
        go = lambda x, _: F.coalesce(F.get(of, x) + (hold + 1), x)  # beyond the last signal there is none
        return F.greatest(F.aggregate(steps, place.cast("int"), go) - k, F.lit(0))

    return let(ahead, lambda of: F.transform(F.sequence(F.lit(0), F.lit(hold)), lambda o: last(of, o)))


def accept(signals: DataFrame, hold: int, by: tuple[str, ...] = (SERIES,), chunk: int = CHUNK) -> DataFrame:
    """(by, pos): the signals (by, pos) taken: greedily, each more than hold after the one before."""
    k = max(chunk, hold + 1)
    cells = signals.groupBy(*by, F.expr(f"pos div {k}").alias("__c")).agg(F.array_sort(F.collect_set("pos")).alias("__ps"))
    maps = _map(F.col("__ps"), F.col("__c") * k, k, hold)
    runs = cells.select(*by, "__c", maps.alias("m")).groupBy(*by, F.expr(f"__c div {chunk}").alias("__r"))
    runs = runs.agg(F.array_sort(F.collect_list(F.struct("__c", "m"))).alias("__cs"))
    places = F.sequence(F.lit(0), F.lit(hold))
    through = F.transform(places, lambda o: _through(F.col("__cs"), "__c", F.col("__r") * chunk - 1, o))
    whole = F.transform(through, lambda e: F.when(e["at"] == F.col("__r") * chunk + chunk - 1, e["place"]).otherwise(0))
    tops = runs.select(*by, "__r", whole.alias("m")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__r", "m"))).alias("__rs"))
    entered = tops.select(*by, F.explode(_entered(F.col("__rs"), "__r", F.lit(-2), F.lit(0))).alias("e")).select(*by, F.col("e.at").alias("__r"), F.col("e.place").alias("__o"))
    inside = runs.join(entered, [*by, "__r"]).select(*by, F.explode(_entered(F.col("__cs"), "__c", F.col("__r") * chunk - 1, F.col("__o"))).alias("e"))
    inside = inside.select(*by, F.col("e.at").alias("__c"), F.col("e.place").alias("__o"))

    def take(acc: Column, p: Column) -> Column:
        before = F.when(F.size(acc) == 0, F.col("__c") * k - hold - 1 + F.col("__o")).otherwise(F.element_at(acc, -1))
        return F.when(p > before + hold, F.concat(acc, F.array(p))).otherwise(acc)

    taken = F.aggregate("__ps", F.expr("cast(array() as array<bigint>)"), take)
    return cells.join(inside, [*by, "__c"]).select(*by, F.explode(taken).alias("pos"))


def held(signals: DataFrame, hold: int, by: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """(by, entry, pos): the hold positions after each accepted signal; the signal's own isn't one."""
    taken = accept(signals, hold, by).withColumnRenamed("pos", "entry")
    after = F.sequence(F.col("entry") + 1, F.col("entry") + hold) if hold else F.array("entry")
    return taken.select(*by, "entry", F.explode(after).alias("pos"))
