"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

Every row's leaf has its place in its group's tree, and every tree its size, before anything is folded; so each
run of ARITY siblings (the last of a level may be shorter) has a known size. A fragment is a sparse forest: the
digests of nodes whose run isn't complete, keyed by tree, level and index. Two fragments merge by putting their
nodes together and folding each run that is now whole into its parent, which may complete the next; this is
associative, and the empty fragment is neutral. Each task folds its own stretch of leaves; fragments are
then merged as in a treeReduce, FAN at a time, in rounds over neighbouring stretches, so that a fragment keeps at
most some nodes for each level at either end of its stretch. The rounds are DataFrames, since they also write
every run that they complete: those are the inner nodes, from which proofs are read from the root down. A finished
tree is a leaf of the tree over groups in the same forest. Only the root comes to the driver.

Cases: a null field is "-", an empty one "0:"; a null group is a group, and the first. Null ids come first in
their group; rows with equal group and id are ordered by leaf, and equal rows are leaves of their own. A group of one row
has that leaf as its root. Without rows there is no root, and no proof. Columns that aren't fields are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, join_spread, numbered, offsets, stored

ARITY = 16
#: Fragments that are merged at once.
FAN = 16
#: The tree over all groups; those of the groups are 0, 1, ...
TOP = -1
_NODES = "done boolean, part long, tree long, level int, idx long, size long, digest binary"
_SCHEMA = pa.schema([("done", pa.bool_()), ("part", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])
_EMPTY = "cast(array() as array<struct<before: binary, after: binary>>)"


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 of fields, each as its byte count, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    n = 0
    while ARITY**n < size:
        n += 1
    return n


class Forest:
    """A fragment: children of runs that aren't complete. Completed runs are moved to done."""

    def __init__(self, trees: int):
        self.trees, self.open, self.root, self.done = trees, {}, None, []

    def add(self, tree: int, level: int, idx: int, size: int, digest: bytes) -> None:
        while (width := -(-size // ARITY**level)) > 1 or tree != TOP:
            if width == 1:  # the root of a group
                tree, level, idx, size = TOP, 0, tree, self.trees
                continue
            run = idx // ARITY
            key = (tree, level, run, size)
            children = self.open.setdefault(key, {})
            children[idx % ARITY] = digest
            if len(children) < min(ARITY, width - ARITY * run):
                return
            del self.open[key]
            whole = b"".join(children[i] for i in range(len(children)))
            self.done.append((tree, level, run, size, whole))
            level, idx, digest = level + 1, run, hashlib.sha256(whole.hex().encode()).digest()
        self.root = (level, digest)

    def completed(self, part: int) -> list[tuple]:
        out = [(True, part, *d) for d in self.done]
        self.done = []
        return out

    def nodes(self, part: int) -> list[tuple]:
        """What another fragment may complete."""
        out = [(False, part, tree, level, ARITY * run + i, size, d) for (tree, level, run, size), c in self.open.items() for i, d in c.items()]
        if self.root is not None:
            out.append((False, part, TOP, self.root[0], 0, self.trees, self.root[1]))
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _fold_leaves(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, forest = None, Forest(trees)
        for batch in batches:
            rows = []
            for p, tree, idx, size, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    rows += forest.completed(part) + forest.nodes(part)
                    part, forest = p, Forest(trees)
                forest.add(tree, 0, idx, size, digest)
            rows += forest.completed(part)
            if rows:
                yield _batch(rows)
        if rows := forest.nodes(part):
            yield _batch(rows)

    return run


def _merge(trees: int):
    def run(fragments: pa.Table) -> pa.Table:
        forest = Forest(trees)
        part = fragments["part"][0].as_py() // FAN
        for row in zip(*(fragments[c].to_pylist() for c in ("tree", "level", "idx", "size", "digest")), strict=True):
            forest.add(*row)
        return pa.Table.from_batches([_batch(forest.completed(part) + forest.nodes(part))])

    return run


class Manifest:
    """Trees over the rows of df: root (hex, null without rows) and proofs().

    also: further columns, made from df's, that proofs() returns with each row."""

    def __init__(self, df: DataFrame, fields: list[str], id_col: str, group_col: str, also: dict[str, Column] | None = None):
        self.also, self.root = list(also or {}), None
        group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("k")
        leaf = F.unhex(leaf_digest(*[F.col(f) for f in fields])).alias("leaf")
        more = F.struct(*[c.alias(n) for n, c in (also or {"none": F.lit(True)}).items()])
        leaves = df.select(group, F.col(id_col).alias("id"), leaf, more.alias("also"), F.monotonically_increasing_id().alias("row"))
        by = ["k", "id", "leaf", "row"]
        ordered = stored(leaves, "leaves").repartitionByRange(*by).sortWithinPartitions(*by).drop("row")
        ordered = stored(ordered.withColumn("part", F.spark_partition_id().cast("long")).withColumn("i", F.monotonically_increasing_id()), "ordered")
        counts = stored(ordered.groupBy("part", "k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i0")), "counts")
        self.trees = numbered(counts.groupBy("k").agg(F.sum("n").alias("size")), [F.col("k")], "tree")
        n_trees, most = self.trees.agg(F.count(F.lit(1)), F.max("size")).first()
        self.height, self.top_height = height(most or 1), height(n_trees)
        places = offsets(counts, ["k"], "part", "n", "start").join(self.trees, "k")
        places = stored(places.select("part", "k", "tree", "size", (F.col("start") - F.col("i0")).alias("shift"), "n"), "places")
        if is_small(places):
            rows = ordered.join(F.broadcast(places.drop("n")), ["part", "k"])
        else:
            rows = join_spread(ordered, places, ["part", "k"], ["tree", "size", "shift"], "n", ["i"])
        self.rows = rows.select("part", "tree", (F.col("i") + F.col("shift")).alias("idx"), "size", "id", "leaf", "also")
        if not is_small(places):  # back into stretches
            self.rows = stored(self.rows.repartitionByRange("tree", "idx").sortWithinPartitions("tree", "idx"), "rows")
        nodes = stored(self.rows.select("part", "tree", "idx", "size", "leaf").mapInArrow(_fold_leaves(n_trees), _NODES), "forest")
        self.runs = nodes.where("done")
        parts = (counts.agg(F.max("part")).first()[0] or 0) + 1
        while parts > 1:
            merged = nodes.where("not done").groupBy(F.expr(f"part div {FAN}")).applyInArrow(_merge(n_trees), _NODES)
            nodes = stored(merged, "forest")
            self.runs = self.runs.unionByName(nodes.where("done"))
            parts = -(-parts // FAN)
        self.last = nodes.where("not done")
        if n_trees:
            (root,) = self.last.limit(2).collect()
            self.root = root["digest"].hex()

    def _down(self, above: DataFrame, level: int, top: bool) -> DataFrame:
        """(tree, idx, digest, subroot, path) of the children of nodes above; path: siblings before and after, level by level from here."""
        tree = F.col("tree") == TOP if top else F.col("tree") != TOP
        runs = self.runs.where(tree & (F.col("level") == level)).select("tree", "idx", F.col("digest").alias("children"))
        each = runs.join(above.drop("digest"), ["tree", "idx"]).withColumn("p", F.explode(F.expr("sequence(0, octet_length(children) div 32 - 1)")))
        step = F.expr("struct(substring(children, 1, 32 * p) AS before, substring(children, 32 * p + 33) AS after)")
        return each.select(
            "tree",
            (F.col("idx") * ARITY + F.col("p")).alias("idx"),
            F.expr("substring(children, 32 * p + 1, 32)").alias("digest"),
            "subroot",
            F.concat(F.array(step), F.col("path")).alias("path"),
        )

    def proofs(self) -> DataFrame:
        """(id, leaf, subroot, path, also...), digests in binary: a row for each of df's."""
        above = self.last.select("tree", "idx", "digest", F.expr("X''").alias("subroot"), F.expr(_EMPTY).alias("path"))
        for level in reversed(range(self.top_height)):
            above = self._down(above, level, top=True)
        tall = sum(((F.col("size") > ARITY**k).cast("int") for k in range(self.height + 1)), F.lit(0))
        starts = above.select(F.col("idx").alias("tree"), "digest", "path").join(self.trees.select("tree", "size"), "tree")
        starts = stored(starts.select("tree", F.lit(0).cast("long").alias("idx"), "digest", F.col("digest").alias("subroot"), "path", tall.alias("h")), "subroots")
        at = lambda h: starts.where(F.col("h") == h).drop("h")
        nodes = at(self.height)
        for level in reversed(range(1, self.height)):
            nodes = self._down(nodes, level, top=False).unionByName(at(level))
        if self.height:
            nodes = nodes.unionByName(at(0))
        runs = self.rows.groupBy("tree", F.expr(f"idx div {ARITY}").alias("idx")).agg(F.first("size").alias("size"), F.collect_list(F.struct("idx", "leaf", "id", "also")).alias("rows"))
        runs = runs.withColumn("rows", F.expr("array_sort(rows, (a, b) -> cast(a.idx - b.idx as int))"))
        runs = runs.withColumn("children", F.expr("aggregate(rows, X'', (all, r) -> concat(all, r.leaf))"))
        each = runs.join(nodes.drop("digest"), ["tree", "idx"]).select("size", "subroot", "path", "children", F.posexplode("rows").alias("p", "r"))
        step = F.expr("array(struct(substring(children, 1, 32 * p) AS before, substring(children, 32 * p + 33) AS after))")
        path = F.when(F.col("size") > 1, F.concat(step, F.col("path"))).otherwise(F.col("path"))
        return each.select("r.id", "r.leaf", "subroot", path.alias("path"), *[F.col(f"r.also.{c}").alias(c) for c in self.also])


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def proof_digest(path: Column) -> Column:
    """Hex SHA-256 of all siblings on the path, as hex text."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hex_of(s["before"]), hex_of(s["after"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root in hex that a leaf in hex has with the siblings of a path."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(hex_of(s["before"]), d, hex_of(s["after"])), 256))
