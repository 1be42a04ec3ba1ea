"""Mixing sources to target weights: blocks of packed words, drawn into output shards by index.

Each source's documents are one stream of words, cut into blocks of fixed length. A source gets as
many slots as its target asks for. All slots are shuffled by seeded hashes and cut into shards, so a
shard's counts are a multinomial draw under the condition that each source meets its total. A source
numbers its slots by the running sums of these counts; its k-th slot takes the block that the source's
own pseudorandom permutation (a Feistel network of hashes) gives k, going round at most twice. Slots and
blocks meet by a join on the index.

Targets: sources in code-point order (null last) weigh 5, 2, 1 and so on repeating; they share
``epochs`` times all words; a target stops at ``most`` times its source's size and the excess is
shared anew by weight, until none is above.

Word positions come from sums over hashed buckets of documents, running sums over sources from sums of
runs of 4096, so no task sees a whole source or all sources.

Cases: null or empty text has size 0 and is never drawn; a null source is a source; rows of equal id
are ordered by size and a hash of the text and each keeps a row of the result; with no words at all every target is 0. Other
columns are ignored. The result depends on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, count_words, numbered, offsets, small_or_join, split_words, stored

BLOCK_WORDS = 256
SLOTS_PER_SHARD = 4096
WEIGHTS = (5, 2, 1)
#: Documents in a bucket of which word positions are summed, and slots in one that is shuffled.
BUCKET_ROWS = 2_000
#: Rounds of the permutation, an even number, and how often a place outside is sent on.
ROUNDS = 6
_WALK = 64
_CHUNK = 4096


def fill_to_caps(sources: DataFrame, epochs: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """sources (source, source_size), a row each, with their rank by name and their target.

    In order of cap by weight, sources are capped as long as their share of what is left reaches the
    cap; the first that isn't, and all after it, get that share."""
    s = numbered(sources, [F.col("source").asc_nulls_last()], "rank")
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = numbered(s, [F.col("cap") / F.col("weight"), F.col("rank")], "turn")
    words, weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    s = stored(offsets(s, [], "turn", ["cap", "weight"], ["caps", "weights"]), "caps")
    level = (F.lit(float(words) * epochs) - F.col("caps")) / (F.lit(weight) - F.col("weights"))
    free = s.withColumn("level", level).where(F.col("cap") > F.col("level") * F.col("weight"))
    level = free.agg(F.min_by("level", "turn")).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", "rank", target.alias("target"))


def permuted(k: Column, n: Column, seed: Column) -> Column:
    """The place of k in a pseudorandom permutation of 0 .. n-1.

    A Feistel network over pairs of Z_a x Z_b, a * b >= n, each round adding a hash of one half to the
    other; what falls outside n goes through again, until it is inside."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def through(x: Column) -> Column:
        named = lambda *c: F.struct(*[v.cast("long").alias(name) for v, name in zip(c, "xypq", strict=True)])
        turn = lambda s, i: named(s["y"], (s["x"] + F.pmod(F.xxhash64(s["y"], seed, i), s["p"])) % s["p"], s["q"], s["p"])
        end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), named(F.floor(x / b), x % b, a, b), turn)
        return end["x"] * end["q"] + end["y"]

    walk = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), x, lambda x, _: F.when(x < n, x).otherwise(through(x)))
    # most places are inside at once: one in about sqrt(n) walks on
    return F.element_at(F.transform(F.array(through(k)), lambda x: F.when(x < n, x).otherwise(walk(x))), 1)


class Mix:
    """The mix of docs, a plan: documents, blocks, slots and what is taken of each document."""

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: float = 1.5,
        most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = 17,
    ):
        self.block_words, self.seed = block_words, seed
        self._text = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
        sized = stored(self._text.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("th")), "sizes")
        buckets = max(1, sized.count() // BUCKET_ROWS)
        sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
        summed = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        offset = offsets(summed, ["source"], "bucket", "words", "offset").select("source", "bucket", "offset")
        totals = summed.groupBy("source").agg(F.sum("words").alias("source_size"))
        self.sources = stored(self._with_slots(fill_to_caps(totals, epochs, most, weights)), "sources")
        self._drawn = stored(self._draw(), "drawn")
        inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "th")
        placed = sized.withColumn("place", F.row_number().over(inside)).withColumn(
            "within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        )
        s, o = placed.alias("s"), offset.alias("o")
        same = F.col("s.source").eqNullSafe(F.col("o.source")) & (F.col("s.bucket") == F.col("o.bucket"))
        documents = s.join(o, same).select("s.doc_id", "s.source", "s.size", "s.th", "s.bucket", "s.place", (F.col("offset") + F.col("within")).alias("start"))
        # stored, as slots are: in one plan with the texts each of its many updates costs the driver memory
        self.documents = stored(documents, "documents")
        self._slots: DataFrame | None = None

    def _with_slots(self, sources: DataFrame) -> DataFrame:
        blocks = F.ceil(F.col("source_size") / self.block_words).cast("long")
        slots = F.when(F.col("source_size") > 0, F.least(2 * blocks, F.round(F.col("target") * blocks / F.col("source_size")).cast("long"))).otherwise(0)
        s = sources.withColumn("blocks", blocks).withColumn("slots", slots.cast("long"))
        s = s.withColumn("own_seed", F.xxhash64(F.col("source"), F.lit(self.seed)))
        return offsets(s, [], "rank", "slots", "first")

    def _draw(self) -> DataFrame:
        """(shard, slot, rank): the source of every slot of the output, by its rank.

        Each slot a source has coming draws a hash; its place in the output is the place of the hash in
        their order, by bucket and then inside it."""
        s = self.sources.where("slots > 0").select("rank", "first", "slots")
        buckets = max((self.sources.agg(F.sum("slots")).first()[0] or 0) // BUCKET_ROWS, 1)
        s = s.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {_CHUNK}")))).repartition("rank", "chunk")
        k = F.explode(F.sequence(F.col("chunk") * _CHUNK, F.least(F.col("chunk") * _CHUNK + _CHUNK, F.col("slots")) - 1))
        s = s.withColumn("k", k).select("rank", (F.col("first") + F.col("k")).alias("card"))
        s = s.withColumn("hash", F.xxhash64(F.lit(self.seed), "card"))
        s = s.select("rank", "card", "hash", F.pmod("hash", F.lit(buckets)).alias("bucket"))
        sizes = s.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        offset = offsets(sizes, [], "bucket", "n", "offset").select("bucket", "offset")
        s = s.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("hash", "card")) - 1)
        s = s.join(offset, "bucket").select("rank", (F.col("offset") + F.col("place")).alias("at"))
        return s.select(F.expr(f"at div {SLOTS_PER_SHARD}").alias("shard"), (F.col("at") % SLOTS_PER_SHARD).alias("slot"), "rank")

    def _small_sources(self) -> DataFrame:
        return small_or_join(self.sources, 100_000)

    def _counts(self) -> DataFrame:
        return self._drawn.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))

    def slots(self) -> DataFrame:
        """(shard, slot, rank, source, block): every slot of the output and the block it takes."""
        if self._slots is None:
            self._slots = stored(self._taking(), "slots")
        return self._slots

    def _taking(self) -> DataFrame:
        starts = offsets(self._counts(), ["rank"], "shard", "n", "before").select("shard", "rank", "before")
        s = self._drawn.withColumn("turn", F.row_number().over(Window.partitionBy("shard", "rank").orderBy("slot")) - 1)
        s = s.join(starts, ["shard", "rank"]).withColumn("k", F.col("before") + F.col("turn"))
        s = s.join(self._small_sources().select("rank", "source", "blocks", "own_seed"), "rank")
        block = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("own_seed"))
        return s.select("shard", "slot", "rank", "source", block.alias("block"))

    def shard_counts(self) -> DataFrame:
        """(shard, source, slots): how many slots of each shard a source got."""
        return self._counts().join(self._small_sources().select("rank", "source"), "rank").select("shard", "source", F.col("n").alias("slots"))

    def pieces(self) -> DataFrame:
        """(source, block, doc_id, size, th, bucket, place, start, from, words): what each block holds of each document."""
        b = self.block_words
        d = self.documents.where("size > 0").withColumn("end", F.col("start") + F.col("size"))
        d = d.withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(end - 1) div {b}"))))
        low, high = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("end"), (F.col("block") + 1) * b)
        return d.select("source", "block", "doc_id", "size", "th", "bucket", "place", "start", (low - F.col("start")).alias("from"), (high - low).alias("words"))

    def taken(self) -> DataFrame:
        """A row for each document: doc_id, source, size, source_size, target, taken."""
        uses = self.slots().groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses")).alias("u")
        p = self.pieces().alias("p")
        drawn = p.join(uses.hint("merge"), F.col("p.source").eqNullSafe(F.col("u.source")) & (F.col("p.block") == F.col("u.block"))).select(
            "p.doc_id", "p.source", "p.bucket", "p.place", (F.col("words") * F.col("uses")).alias("taken"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("here")
        )
        every = self.documents.select("doc_id", "source", "bucket", "place", F.lit(0).cast("long").alias("taken"), "size", F.lit(1).alias("here"))
        sums = every.unionByName(drawn).groupBy("source", "bucket", "place", "doc_id").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).alias("t")
        s = self._small_sources().alias("s")
        return sums.join(s, F.col("t.source").eqNullSafe(F.col("s.source"))).select("doc_id", "t.source", "size", "source_size", "target", "taken")

    def texts(self) -> DataFrame:
        """(shard, slot, source, doc_ids, text): the mixed output, one row for each slot; doc_ids in the order of their words."""
        b = self.block_words
        key = lambda *names: F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)]).alias("key")
        t = self._text.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("th"), "text").where("size > 0")
        t = t.select(key("doc_id", "source", "size", "th"), "text").groupBy("key").agg(F.min("text").alias("text"))  # copies of a row have one text
        s = self._small_sources().select(F.col("source").alias("name"), "rank")
        d = self.documents.where("size > 0").join(s, F.col("source").eqNullSafe(F.col("name")))
        d = d.select(key("doc_id", "source", "size", "th"), "doc_id", "rank", "start", (F.col("start") + F.col("size")).alias("end")).join(t, "key")

        def cut(words: Column, block: Column) -> Column:
            low, high = F.greatest(F.col("start"), block * b), F.least(F.col("end"), (block + 1) * b)
            inside = F.slice(words, (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
            return F.struct(block.alias("block"), F.struct(low.alias("low"), F.col("doc_id"), F.array_join(inside, " ").alias("text")).alias("cut"))

        blocks = F.sequence(F.expr(f"start div {b}"), F.expr(f"(end - 1) div {b}"))
        # the words are split once for a document: inside the outer transform they are a variable
        cuts = F.flatten(F.transform(F.array(split_words(F.col("text"), SPACES)), lambda w: F.transform(blocks, lambda x: cut(w, x))))
        rows = d.select("rank", F.explode(cuts).alias("c")).select("rank", "c.block", "c.cut")
        whole = rows.groupBy("rank", "block").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
        text = F.array_join(F.transform("cuts", lambda c: c["text"]), " ")
        whole = whole.select("rank", "block", F.transform("cuts", lambda c: c["doc_id"]).alias("doc_ids"), text.alias("text"))
        return self.slots().join(whole.hint("merge"), ["rank", "block"]).select("shard", "slot", "source", "doc_ids", "text")
