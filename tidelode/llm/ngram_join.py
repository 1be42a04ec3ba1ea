"""N-gram Jaccard self-join: blocked sparse products of document by n-gram incidence, with size bounds.

Two documents link when num/den or more of their united word n-grams are common. Equal sets are one
class with its smallest doc_id as representative; only representatives go on.

1. Survivors. A document all of whose partners together hold fewer of its n-grams than the threshold
   asks for can't link. N-grams are dealt by hash into blocks; each block holds short fingerprints of
   chunks of documents and sends back how many of a document's n-grams are its own alone. What a
   chunk holds several times it sends once, so a common n-gram costs a row for each chunk at most.
   Done over all documents, then again among the survivors, where blocks also send back how many
   documents hold each n-gram.
2. Candidates. Each set's n-grams, the rarest first, have a prefix that a partner must share a part of
   (a shorter one for the smaller of the two), with bounds from both sizes, from the n-grams that
   others hold, and from the places in the two sets. What many documents have in common, such as a
   licence, comes last and isn't in the prefixes.
3. Contraction. In rounds, each document is compared with a few leaders (the least by a hash of the
   round) of the most frequent other component in its n-grams' lists, those with whom it shares most
   prefix n-grams first. Links give components, which takes groups of copies together without
   their pairs; what a round tests is linear in the lists.
4. The rest. A document outside the most frequent component of an n-gram's list is compared with all
   blocks of documents of which one is in the list and could link with it, by sizes and places; then
   components again.

Comparing is a product of incidence blocks: the n-grams of up to MEMBERS documents against those of
another, all overlaps counted at once. It is exact; steps 1 to 4 leave out no pair that could
connect what is not connected yet.

Cases: null, empty and blank texts have no n-grams and link with nothing; texts of fewer words than
n have one n-gram, the whole. Rows of equal id are documents of their own. A null id links with
nothing, its component is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, own_name, small_or_join, stored
from .components import components
from .shingles import set_digests, sets_of

#: N-grams that a chunk gathers before it deals them out, and those that a block gets, about.
CHUNK_GRAMS = 400_000
BLOCK_GRAMS = 1_500_000
#: Documents that are put into a chunk at once; a chunk has fewer than 65,535.
CHUNK_DOCS = 8192
#: Documents in a block, and those compared with it in one task.
MEMBERS = 256
#: Rounds of contraction: leaders of an n-gram's list, and leaders that a document is compared with.
ROUNDS = (2, 32)


def set_table(docs: DataFrame, n: int, with_sets: bool) -> DataFrame:
    """(doc_id, n, d1, d2[, grams]) of docs (doc_id, text); grams are little-endian 64-bit words, ascending."""
    schema = "doc_id long, n long, d1 long, d2 long" + ", grams binary" * with_sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, b, hashes, counts in sets_of(text, n):
                d1, d2 = set_digests(hashes, counts)
                cols = [ids.slice(a, b - a), pa.array(counts), pa.array(d1), pa.array(d2)]
                if with_sets:
                    ends = np.concatenate(([0], np.cumsum(counts))) * 8
                    cols.append(pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(hashes)]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "d1", "d2", "grams"][: len(cols)])

    return docs.mapInArrow(run, schema)


def _from_text(n: int):
    def sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, hashes, counts in sets_of(batch.column(1), n):
            yield ids[a:b], hashes, counts

    return sets


def _from_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of (id, n, grams)."""
    ids, counts, grams = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2)
    for a in range(0, len(ids), 512):
        part = [np.frombuffer(x.as_buffer(), np.uint64) for x in grams[a : a + 512]]
        yield ids[a : a + 512], np.concatenate(part) if part else np.zeros(0, np.uint64), counts[a : a + 512]


def _uniques(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of h by block and hash: n-gram, block, how often it is in h, a place of it in h; and where blocks begin."""
    order = np.argsort(h)
    s = h[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(s), 1), bool), s[1:] != s[:-1])))
    n, one, s = np.diff(np.append(at, len(s))), order[at], s[at]
    block = ((s >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    by = np.argsort(block, kind="stable")
    block = block[by]
    cut = np.flatnonzero(np.concatenate((np.ones(min(len(s), 1), bool), block[1:] != block[:-1])))
    return s[by], block, n[by], one[by], np.append(cut, len(s))


def _deal(sets, blocks: int, whole: bool):
    """Chunks of documents dealt into blocks: (block, chunk, kind, data, owners, more).

    kind 0: the fingerprints of one block, which of the chunk's documents holds each (_SEVERAL: more than
    one) and how many do where it is several. kind 1: the chunk's documents: ids, counts and, if whole, n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = (TaskContext.get().partitionId() + 1) << 32
        ids, hashes, counts, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, held
            i, h, c = np.concatenate(ids), np.concatenate(hashes), np.concatenate(counts)
            ids.clear(), hashes.clear(), counts.clear()
            held, serial = 0, serial + 1
            u, block, n, one, ends = _uniques(h, blocks)
            owner = np.where(n > 1, _SEVERAL, np.repeat(np.arange(len(c)), c)[one]).astype(np.uint16)
            prints, n = u.astype(np.uint32), n.astype(np.uint32)
            rows = [(int(block[a]), serial, 0, prints[a:b].tobytes(), owner[a:b].tobytes(), n[a:b][n[a:b] > 1].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            rows.append((serial % blocks, serial, 1, i.astype(np.int64).tobytes(), c.tobytes(), h.tobytes() if whole else b""))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _DEALT, strict=True)], names=list("abcdef"))

        for batch in batches:
            for i, h, c in sets(batch):
                ends = np.concatenate(([0], np.cumsum(c)))
                for a in range(0, len(i), CHUNK_DOCS):
                    if ids and (held >= CHUNK_GRAMS or sum(map(len, ids)) + CHUNK_DOCS >= _SEVERAL):
                        yield from flush()
                    b = min(a + CHUNK_DOCS, len(i))
                    ids.append(i[a:b]), hashes.append(h[ends[a] : ends[b]]), counts.append(np.asarray(c[a:b], np.int64))
                    held += int(ends[b] - ends[a])
        if ids:
            yield from flush()

    return run


_DEALT = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_DEALT_SQL = "block long, chunk long, kind int, data binary, owners binary, more binary"
_SEVERAL = 0xFFFF


def _meet(frequencies: bool):
    """One block: for each chunk, how many fingerprints of each document are in no other chunk; and all their
    frequencies over all chunks as steps of an eighth of a power of two, 0 for once."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kind == 1))]
        part = table.filter(pa.array(kind == 0))
        prints = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.column("data")]
        if prints:
            owner = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in part.column("owners")])
            h = np.concatenate(prints)
            held = np.ones(len(h), np.uint32)
            held[owner == _SEVERAL] = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in part.column("more")])
            sizes = np.array([len(x) for x in prints])
            row = np.repeat(np.arange(len(prints), dtype=np.uint32), sizes)
            order = np.argsort(h)
            h, owner, row, held = h[order], owner[order], row[order], held[order]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            total = np.add.reduceat(held, starts, dtype=np.int64)
            alone = starts[total == 1]
            both, n = np.unique(row[alone].astype(np.int64) << 16 | owner[alone], return_counts=True)
            ends = np.searchsorted(both, np.arange(len(prints) + 1, dtype=np.int64) << 16)
            data = [(both[a:b] & 0xFFFF).astype(np.uint16).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            counts = [n[a:b].astype(np.uint32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            more = [b""] * len(prints)
            if frequencies:
                step = np.empty(len(h), np.uint8)
                step[order] = np.repeat(np.minimum(np.log2(total) * 8, 255).astype(np.uint8), np.diff(np.append(starts, len(h))))
                at = np.concatenate(([0], np.cumsum(sizes)))
                more = [step[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            cols = [pa.array(data, pa.binary()), pa.array(counts, pa.binary()), pa.array(more, pa.binary())]
            out.append(pa.table([*(part.column(c) for c in ("block", "chunk", "kind")), *cols], names=table.column_names))
        return pa.concat_tables(out)

    return run


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """One chunk: ids, counts, how many n-grams are a document's own alone, all n-grams, their frequencies by block."""
    own = ids = total = grams = None
    replies, steps = [], []
    for block, kind, data, owners, more in zip(*(table.column(c).to_pylist() if c in ("block", "kind") else table.column(c) for c in ("block", "kind", "data", "owners", "more")), strict=True):
        if kind == 1:
            ids, total, grams = np.frombuffer(data.as_buffer(), np.int64), np.frombuffer(owners.as_buffer(), np.int64), np.frombuffer(more.as_buffer(), np.uint64)
            own = np.zeros(len(ids), np.int64)
        else:
            replies.append((np.frombuffer(data.as_buffer(), np.uint16), np.frombuffer(owners.as_buffer(), np.uint32)))
            steps.append((block, more.as_py()))
    for who, n in replies:
        own[who] += n
    return ids, total, own, grams, [x for _, x in sorted(steps)]


def _answer(table: pa.Table) -> pa.Table:
    """One chunk: (doc_id, n, shared) of its documents."""
    ids, total, own, _, _ = _gathered(table)
    return pa.table([pa.array(ids), pa.array(total), pa.array(total - own)], names=["doc_id", "n", "shared"])


def _prefixes(num: int, den: int, blocks: int):
    """One chunk: its documents with their shared counts and prefixes: (cid, n, s, grams, prefix).

    The prefix is what the n-grams that others hold have in the first n - need + 1 places by rarity."""

    def run(table: pa.Table) -> pa.Table:
        ids, n, own, grams, steps = _gathered(table)
        s, need = n - own, -(-n * num // den)
        step = np.frombuffer(b"".join(steps), np.uint8)
        u = _uniques(grams, blocks)[0]
        order = np.argsort(u)
        freq = step[order][np.searchsorted(u[order], grams)]
        doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n)  # of what lexsort puts there
        ranked = np.lexsort((grams, freq, doc))
        taken = (place >= np.repeat(own, n)) & (place <= np.repeat(n - need, n)) & np.repeat(s >= need, n)
        size = np.bincount(doc[taken], minlength=len(n)) * 8
        both = []
        for x, k in ((grams, n * 8), (grams[ranked][taken], size)):
            offs = np.concatenate(([0], np.cumsum(k))).astype(np.int32)
            both.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(x))]))
        out = pa.table([pa.array(ids), pa.array(n), pa.array(s), *both], names=["cid", "n", "s", "grams", "prefix"])
        return out.filter(pa.array(s >= np.maximum(need, 1)))

    return run


def shared_counts(rows: DataFrame, sets, blocks: int) -> DataFrame:
    """(doc_id, n, shared): how many of a document's n-grams some other document may hold, never too few."""
    met = rows.mapInArrow(_deal(sets, blocks, False), _DEALT_SQL).groupBy("block").applyInArrow(_meet(False), _DEALT_SQL)
    return met.groupBy("chunk").applyInArrow(_answer, "doc_id long, n long, shared long")


def rarest_first(sets: DataFrame, num: int, den: int, blocks: int) -> DataFrame:
    """(cid, n, s, grams, prefix) of sets (cid, n, grams) that may link: s of the n-grams are others' too, the prefix is by rarity."""
    dealt = stored(sets.mapInArrow(_deal(_from_sets, blocks, True), _DEALT_SQL), "dealt")
    met = dealt.where("kind = 0").groupBy("block").applyInArrow(_meet(True), _DEALT_SQL)
    return met.unionByName(dealt.where("kind = 1")).groupBy("chunk").applyInArrow(_prefixes(num, den, blocks), "cid long, n long, s long, grams binary, prefix binary")


def _prefix_rows(num: int, den: int):
    """(gram, cid, n, s, place, small) for each n-gram of (cid, n, s, prefix); n-grams that nobody else has come before the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, n, s = (batch.column(i).to_numpy() for i in range(3))
            grams = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3)]
            p = np.array([len(x) for x in grams], np.int64)
            if not p.sum():
                continue
            place = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p) + np.repeat(n - s, p)
            index = n + (2 * n * num // -(num + den)) + 1  # n - ceil(2 n num / (num + den)) + 1
            cols = [np.concatenate(grams), *(np.repeat(x, p) for x in (cid, n, s)), place, place < np.repeat(index, p)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["gram", "cid", "n", "s", "place", "small"])

    return run


def _multiply(num: int, den: int):
    """Products of incidence blocks: rows (block, doc, component, grams), each block's own documents (with a
    component) before those that it is compared with (without). Links (a, b) that join all components and
    documents that link in the block, no more of them than there are documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, sets, parts = None, [], [], []
        columns, joined_to = None, {}
        for batch in batches:
            links = []
            for k, doc, part, data in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                grams = np.frombuffer(data.as_buffer(), np.uint64)
                if part is not None:
                    if k != block or columns is not None:  # the same block comes again with each salt
                        block, own, sets, parts, columns, joined_to = k, [], [], [], None, {}
                    own.append(doc), sets.append(grams.copy()), parts.append(part)
                    continue
                assert k == block
                if columns is None:  # the block by n-gram: which of its documents have each
                    sizes, of = np.array([len(x) for x in sets]), np.array(parts)
                    joined = np.concatenate(sets)
                    order = np.argsort(joined, kind="stable")
                    keys, starts = np.unique(joined[order], return_index=True)
                    rows = np.repeat(np.arange(len(sets)), sizes)[order]
                    columns = keys, np.append(starts, len(joined)), rows
                keys, starts, rows = columns
                at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                at = at[keys[at] == grams]
                runs = starts[at + 1] - starts[at]
                hit = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum()) if len(at) else at
                both = np.bincount(rows[hit], minlength=len(sizes))
                linked = np.flatnonzero((den * both >= num * (sizes + len(grams) - both)) & (np.array(own) != doc))
                first = None  # of several components only those go out that no document before has joined here
                for i in linked[np.unique(of[linked], return_index=True)[1]]:
                    c = int(of[i])
                    while c in joined_to:
                        c = joined_to[c]
                    if first is None:
                        first = c
                        links.append((own[i], doc))
                    elif c != first:
                        joined_to[c] = first
                        links.append((own[i], doc))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    return run


def _links(blocks: DataFrame, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of blocks (block, cid, component) with the documents of pairs (block, cid), MEMBERS of these at a time."""
    many = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    own = blocks.join(many, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = pairs.join(many, "block").withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    wanted = own.select("cid", "block", "salt", "component").unionByName(other.select("cid", "block", "salt", F.lit(None).cast("long").alias("component")))
    rows = wanted.join(sets.select("cid", "grams"), "cid").select("block", "salt", "cid", "component", "grams")
    rows = rows.repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("component").asc_nulls_last(), "cid")
    return rows.select("block", "cid", "component", "grams").mapInArrow(_multiply(num, den), "a long, b long")


def _fits(x: str, y: str, num: int, den: int) -> Column:
    """Whether sizes and shared counts of two prefix rows allow a link; x is the smaller or equal set."""
    nx, ny, sx, sy = (F.col(f"{t}.{c}") for c in ("n", "s") for t in (x, y))
    px, py = F.col(f"{x}.place"), F.col(f"{y}.place")
    room = F.least(sx, sy, nx - px, ny - py)
    return (nx * den >= ny * num) & (room * (num + den) >= (nx + ny) * num)


def _fit_any(num: int, den: int) -> Column:
    """Whether prefix rows x and y, of one n-gram, may belong to sets that link."""
    x_small = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cid") < F.col("y.cid")))
    return F.when(x_small, F.col("x.small") & _fits("x", "y", num, den)).otherwise(F.col("y.small") & _fits("y", "x", num, den))


def _mixed(prefix: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Rows of n-grams that several components have, with their component and each list's most frequent one (top)."""
    if parts is None:
        of = prefix.withColumn("component", F.col("cid"))
    else:
        of = stored(prefix.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), "prefixes")
    each = of.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("m"))
    lists = each.groupBy("gram").agg(F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    return stored(of.join(lists.select("gram", F.col("top.component").alias("top")), "gram"), "mixed")


def _rest(mixed: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (block, cid, component) of the documents in mixed lists, and the documents (block, cid) to compare with each.

    A block has documents of one family: of one component, and those without one that most often meet
    it as the top of their lists. A document goes to a block if it is outside the top component of
    a list in which a document of the block could link with it, by the block's extremes."""
    docs = mixed.groupBy("cid", "component", "top").agg(F.count(F.lit(1)).alias("m"))
    docs = docs.groupBy("cid", "component").agg(F.max(F.struct("m", "top")).alias("t"))
    sizes = docs.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    docs = docs.join(sizes, "component").select("cid", "component", F.when(F.col("k") > 1, F.col("component")).otherwise(F.col("t.top")).alias("family"))
    wide = docs.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    docs = docs.join(wide, "family")
    blocks = stored(docs.select(F.xxhash64("family", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("block"), "cid", "component"), "blocks")
    of = mixed.join(blocks.select("cid", "block"), "cid")
    extremes = of.groupBy("gram", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.least("s", F.col("n") - F.col("place"))).alias("room"), F.min("component").alias("c"), F.max("component").alias("d"), F.max("small").alias("small")
    )
    x = mixed.where("component <> top").alias("x")
    e = extremes.alias("e")
    least = F.greatest(F.col("low"), F.floor(F.col("x.n") * num / den))
    room = F.least("x.s", F.col("x.n") - F.col("x.place"), F.col("room"))
    fits = (F.col("high") * den >= F.col("x.n") * num) & (F.col("x.n") * den >= F.col("low") * num) & (room * (num + den) >= (F.col("x.n") + least) * num)
    other = (F.col("c") != F.col("d")) | (F.col("c") != F.col("component"))
    pairs = x.join(e, F.col("x.gram") == F.col("e.gram")).where(fits & other & (F.col("x.small") | F.col("e.small"))).select("block", "x.cid").distinct()
    return blocks, stored(pairs, "pairs")


def link_classes(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; component_id is the least linked doc_id."""
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = stored(set_table(text, n, False), "sets")
    linked = text.where("doc_id is not null")
    grams = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams // BLOCK_GRAMS))
    classes = every.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "classes")
    doubled = not classes.groupBy("least").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()  # an id with several texts
    classes = numbered(classes, [F.col(c) for c in ("least", "d1", "d2", "n")], "cid") if doubled else classes.withColumn("cid", F.col("least"))
    counted = stored(shared_counts(linked, _from_text(n), blocks), "shared")
    enough = counted.where(F.expr(f"n > 0 and shared * {den} >= n * {num}")).select("doc_id").distinct()
    alive = stored(enough.join(classes.select(F.col("least").alias("doc_id")), "doc_id", "left_semi"), "survivors")
    sets = set_table(linked.join(small_or_join(alive), "doc_id", "left_semi"), n, True)
    sets = stored(sets.join(classes.select("d1", "d2", "n", "least", "cid"), ["d1", "d2", "n"]).where("doc_id = least").select("cid", "n", "grams"), "grams")
    sets = stored(rarest_first(sets, num, den, blocks), "grams")
    prefix = stored(sets.select("cid", "n", "s", "prefix").mapInArrow(_prefix_rows(num, den), "gram long, cid long, n long, s long, place long, small boolean"), "prefixes")

    parts, edges, tested = None, None, None
    for salt, reps in enumerate(ROUNDS):
        mixed = _mixed(prefix, parts)
        order = Window.partitionBy("gram").orderBy(F.xxhash64("cid", F.lit(salt)), "cid")
        leaders = mixed.where("component = top").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= reps)
        found = mixed.where("component <> top").alias("x").join(leaders.alias("y"), "gram").where(_fit_any(num, den))
        found = found.groupBy(F.col("x.cid").alias("cid"), F.col("y.cid").alias("block")).agg(F.count(F.lit(1)).alias("m"))
        best = Window.partitionBy("cid").orderBy(F.desc("m"), F.xxhash64("block", F.lit(salt)), "block")
        pairs = found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= reps).select("block", "cid")
        if tested is not None:
            pairs = pairs.join(tested, ["block", "cid"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        alone = pairs.select("block", F.col("block").alias("cid"), F.col("block").alias("component")).distinct()
        new = _links(alone, pairs, sets, num, den)
        edges = stored(new if edges is None else edges.unionByName(new), "links")
        parts = stored(components(edges), "components")

    blocks, pairs = _rest(_mixed(prefix, parts), num, den)
    edges = stored(edges.unionByName(_links(blocks, pairs, sets, num, den)), "links")
    parts = stored(components(edges), "components")

    groups = classes.join(parts.withColumnRenamed("node", "cid"), "cid", "left").where("copies > 1 or component is not null")
    groups = groups.select("d1", "d2", "n", F.coalesce("component", "cid").alias("component"))
    if doubled:
        groups = groups.join(classes.select(F.col("cid").alias("component"), "least"), "component").select("d1", "d2", "n", F.col("least").alias("component"))
    out = every.join(small_or_join(stored(groups, "groups")), ["d1", "d2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(own, "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without those that are linked, directly or by others, to one with a smaller doc_id.

    Of rows of equal id and text one stays; rows of equal id and other texts are documents of their own, in
    order of a hash of the text. Rows with a null id, and texts without words, stay."""
    key, th = own_name(docs, "key"), own_name(docs, "th")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").alias(key))
    again = stored(ids.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "again")
    if again.isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id"))
    else:  # a number for each id and text, in order of id
        t, again = docs.withColumn(th, F.xxhash64("text")), small_or_join(again.withColumnRenamed(key, "doc_id"))
        t = t.join(again, "doc_id", "left_anti").unionByName(t.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", th]))
        numbers = numbered(t.where("doc_id is not null").select("doc_id", th), [F.col("doc_id"), F.col(th)], key)
        keyed = stored(t.join(numbers, ["doc_id", th], "left"), "keyed")
    linked = link_classes(keyed.select(key, "text"), n, num, den, id_col=key)
    gone = stored(linked.where("component_id < doc_id").select(F.col("doc_id").alias(key)), "duplicates")
    return keyed.join(small_or_join(gone), key, "left_anti").select(*docs.columns)
