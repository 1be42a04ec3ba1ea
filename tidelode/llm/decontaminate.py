"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of ``window`` consecutive words; an item of fewer words is one
window. A window is the set of its shingles of SHINGLE words at their places. Since a document must
contain all of them, one shingle is a sufficient prefix: the rarest one, by occurrences counted over
all documents. Shingles of documents meet the prefixes in an equi-join; the place of the shingle in
its window bounds where the window can lie in the document (position) and how long the document must
be (length); what remains is compared word by word.

A window whose rarest shingle occurs nowhere is dropped beforehand. At most BLOCK_ROWS windows, of a
checked size in bytes, are broadcast. Of a longer benchmark only the keys are, in blocks of at most
KEY_ROWS numbers, with a pass over the documents for each block; the places that meet a key, with the
words around them, then join their windows by a shuffle.

Cases: null and empty texts have no words; an item without words has no window; equal windows of
several items count for all of them; every row is a document of its own, also one of equal doc_id or
with a null one. No items leave everything
clean. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_SHARE, ascii_lower, is_small, own_name, small_or_join, split_words, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
BLOCK_ROWS = 100_000
#: 64-bit keys that are broadcast at once.
KEY_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, wid, win): the distinct windows of each item; wid is the digest of the words."""
    w = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    w = w.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), F.lit(window)).alias("win"))
    return w.select("item_id", F.md5(F.array_join("win", " ")).alias("wid"), "win").distinct()


def _places(df: DataFrame, words: str, sizes: list[int], with_rows: bool) -> DataFrame:
    """df with a row for each place p of its words and each shingle size: p, key (null: no shingle there).

    with_rows: also a row with p -1 and no key for each row of df."""
    padded = lambda w: F.concat(F.array(F.lit(None).cast("string")), w) if with_rows else w
    later = lambda k: F.slice(words, k, F.greatest(F.size(words), F.lit(1)))
    zipped = F.arrays_zip(padded(F.col(words)).alias("a"), padded(later(2)).alias("b"), padded(later(3)).alias("c"))
    rows = df.select("*", F.posexplode(zipped).alias("p", "z"))
    if with_rows:
        rows = rows.withColumn("p", F.col("p") - 1)
    firsts = [F.col(f"z.{x}") for x in rows.schema["z"].dataType.fieldNames()]
    keys = [F.when((F.col("p") >= 0) & (F.col("p") + k <= F.size(words)), F.xxhash64(*firsts[:k])) for k in sizes]
    many = F.when(F.col("p") >= 0, F.array(*keys)).otherwise(F.array(F.lit(None).cast("long")))
    rows = rows.withColumn("key", keys[0] if len(keys) == 1 else F.explode(many))
    return rows.drop("z")


def _prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, off, n, wid, win): each window's rarest shingle in all documents, if it occurs there."""
    w = windows.select("wid", "win").distinct()
    shingles = _places(w, "win", sizes, False)
    # a window's shingles are all of the size that it is long enough for
    sized = F.least(F.size("win"), F.lit(SHINGLE))
    if len(sizes) > 1:
        firsts = [F.element_at("win", F.col("p") + 1 + i) for i in range(SHINGLE)]
        right = reduce(lambda c, k: c.when(sized == k, F.xxhash64(*firsts[:k])), sizes, F.when(F.lit(False), F.lit(0).cast("long")))
        shingles = shingles.where((F.col("p") + sized <= F.size("win")) & (F.col("key") == right))
    shingles = stored(shingles.where("key is not null").select("key", F.col("p").alias("off"), F.size("win").alias("n"), "wid", "win"), "shingles")
    keys = stored(shingles.select("key").distinct(), "keys")
    counts = []
    for block in _blocks(keys):
        rows = _places(docs.select("words"), "words", sizes, False).select("key").join(F.broadcast(block), "key")
        counts.append(rows.groupBy("key").agg(F.count(F.lit(1)).alias("freq")))
    freq = stored(reduce(DataFrame.unionByName, counts), "freq")
    rare = F.min(F.struct("freq", "key", "off", "n", "win")).alias("r")
    best = shingles.join(small_or_join(freq), "key", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    return best.groupBy("wid").agg(rare).where("r.freq > 0").select("r.key", "r.off", "r.n", "wid", "r.win")


def _blocks(keys: DataFrame) -> list[DataFrame]:
    """keys, a stored table of distinct keys, in parts of about KEY_ROWS at most."""
    df, n = keys, -(-keys.count() // KEY_ROWS) or 1
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64("key"), F.lit(n)) == b) for b in range(n)]


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_words, start, n, wid): a row for each occurrence, and one with null wid for each row of docs."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), words_of(F.col(text_col)).alias("words"))
    sizes = [r[0] for r in windows.select(F.least(F.size("win"), F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect()] or [SHINGLE]  # SHINGLE values at most
    prefixes = stored(_prefixes(docs, windows, sizes), "prefixes")
    if is_small(prefixes, BLOCK_ROWS):
        met, first = _places(docs, "words", sizes, True).join(F.broadcast(prefixes), "key", "left"), F.lit(1)
        rows = met.select("doc_id", "th", F.size("words").alias("n_words"), "p", "off", "n", "wid", "win", first.alias("first"), "words")
    else:
        rows = _met_by_shuffle(docs, prefixes, sizes)
    start = F.col("p") - F.col("off")
    fits = F.col("wid").isNotNull() & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    hit = F.when(fits, F.slice("words", F.when(fits, start + 2 - F.col("first")).otherwise(1), F.coalesce("n", F.lit(0))) == F.col("win")).otherwise(False)
    rows = rows.select("doc_id", "th", "n_words", "p", hit.alias("hit"), start.alias("start"), "n", "wid")
    return rows.where(F.col("hit") | (F.col("p") < 0)).drop("p", "hit")


def _met_by_shuffle(docs: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame:
    """What hits() compares, for more prefixes than are broadcast: rows of p -1, and places with the windows of their key.

    words are those around the place, from the document's word number first (from 1) on. Places of hot
    keys stay where they are and meet their windows by a checked broadcast."""
    most = prefixes.agg(F.max("n")).first()[0]
    parts = []
    for block in _blocks(stored(prefixes.select("key").distinct(), "keys")):
        rows = _places(docs, "words", sizes, not parts).join(F.broadcast(block.withColumn("listed", F.lit(True))), "key", "inner" if parts else "left")
        first = F.greatest(F.col("p") + 1 - most, F.lit(1))
        around = F.when(F.col("listed"), F.slice("words", first, F.lit(2 * most)))
        parts.append(rows.where("listed or p < 0").select("key", "doc_id", "th", F.size("words").alias("n_words"), "p", first.alias("first"), around.alias("words")))
    met = stored(reduce(DataFrame.unionByName, parts), "met")
    counts = stored(met.where("p >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "counts")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("rows") * HOT_SHARE > total).select("key"))  # at most HOT_SHARE numbers
    columns = ["doc_id", "th", "n_words", "p", "off", "n", "wid", "win", "first", "words"]
    places, none = met.where("p >= 0"), {c: F.lit(None).cast(prefixes.schema[c].dataType) for c in ("off", "n", "wid", "win")}
    cold = places.join(hot, "key", "left_anti").join(prefixes, "key")
    warm = places.join(hot, "key", "left_semi").join(small_or_join(stored(prefixes.join(hot, "key", "left_semi"), "hot")), "key")
    return reduce(DataFrame.unionByName, [df.select(*columns) for df in (met.where("p < 0").withColumns(none), cold, warm)])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    windows = stored(item_windows(items, window), "windows")
    all_rows = stored(hits(docs, windows, id_col, text_col), "hits")
    hit, doc = all_rows.where("wid is not null"), ["doc_id", "th"]
    spans = hit.select(*doc, "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy(*doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    covered = spans.select(*doc, new.alias("new")).groupBy(*doc).agg(F.sum("new").alias("n_hit"))
    owners = small_or_join(windows.select("wid", F.col("item_id").cast("string").alias("item")))
    ids = hit.select(*doc, "wid").distinct().join(owners, "wid").groupBy(*doc).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    sizes = all_rows.where("wid is null").groupBy(*doc, "n_words").agg(F.count(F.lit(1)).alias("copies"))
    parts = {"n_words": "int", "copies": "long", "n_hit": "long", "item_ids": "array<string>"}
    whole = [df.select(*doc, *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in parts.items()]) for df in (sizes, covered, ids)]
    out = reduce(DataFrame.unionByName, whole).groupBy(*doc).agg(*[F.max(c).alias(c) for c in parts])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that contain a window of an item; rows of equal id and other texts are told apart."""
    key = own_name(docs, "key")
    keyed = docs.withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("th")))
    gone = stored(decontaminate(keyed, items, window, id_col=key).where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(small_or_join(gone, BROADCAST_ROWS), key, "left_anti").select(*docs.columns)  # a struct is never null
