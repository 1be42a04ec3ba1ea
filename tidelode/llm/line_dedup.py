r"""Line dedup: a suffix array over line-ID sequences by prefix doubling finds repeated runs of lines.

Every line is an ID (128 bits of the SHA-256 of its words); a document is a sequence of IDs. Ranks of all suffixes by
their first 1, 2, 4, ... lines are computed by prefix doubling: the rank for twice the length is the
order of the pairs (rank here, rank that many lines on), found by a range-partitioned sort of the
distinct pairs. Positions whose rank is theirs alone start no repeated run and leave. Suffixes that
agree in their first L lines are an interval of the suffix array with longest common prefix L or
more; two ranks of length 2^k <= L, at either end of the L lines, name the interval.

A run counts from ``min_words`` words. Every line of a maximal repeated run of that size lies in a
shortest such run that starts, or that ends, inside it; so the intervals of the shortest runs, from
each line forwards and backwards, reveal exactly the lines of all maximal repeated runs. The first
copy, by doc_id and line, stays; the lines of later copies that don't overlap it are deleted. Depth
is bounded: a shortest run has at most min_words lines, so there are log2(min_words) doublings.

Lines end at line feeds; blank lines belong to the line before. White space inside a line is compared
as one blank.

Cases: null text stays null, empty text empty, without lines. Rows with equal id and text are one
document and get the same result; rows with equal id and other texts are ordered by a hash of the
text. A null id comes first. Other columns pass through. No rows give no rows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, join_spread, numbered, own_name, small_or_join, stored

MIN_WORDS = 50
#: A line feed, unless what follows up to the next one is blank.
_LINE_END = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"
_DOC = ("did", "th")


def _lines(text: Column) -> Column:
    return F.split(text, _LINE_END)


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """did, th: what makes a document."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"),
        F.xxhash64(F.col(text_col), F.col(id_col).isNull()).alias("th"),
    ]


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, th, ln, w, r0): lines that occur more than once, with their words and the rank of their ID."""
    t = docs.where(F.col(text_col).isNotNull()).select(*_keys(docs, id_col, text_col), F.col(text_col).alias("text"))
    again = stored(t.groupBy(*_DOC).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_DOC), "again")
    if again.isEmpty():
        t = _hashed(t)
    else:  # of rows that are one document, one; only their lines are shuffled
        again = small_or_join(again)
        t = _hashed(t.join(again, list(_DOC), "left_anti")).unionByName(_hashed(t.join(again, list(_DOC), "left_semi")).distinct())
    t = stored(t, "all-lines")
    many = t.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _ranked(t, many, ["line"], "r0").select("did", "th", "ln", "w", "r0")


def _hashed(docs: DataFrame) -> DataFrame:
    """(did, th, ln, w, line): the lines of docs (did, th, text) that have words; line is half of a SHA-256."""
    t = docs.select(*_DOC, F.posexplode(_lines(F.col("text"))).alias("ln", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    loose = F.contains(F.col("line"), F.lit("  ")) | F.col("line").rlike(r"[\x09-\x0D]")
    t = t.select(*_DOC, "ln", F.trim(F.when(loose, F.regexp_replace("line", SPACES, " ")).otherwise(F.col("line"))).alias("norm"))
    blanks = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit("")))
    return t.select(*_DOC, "ln", (blanks + 1).cast("int").alias("w"), F.substring(F.unhex(F.sha2("norm", 256)), 1, 16).alias("line"))


def _ranked(rows: DataFrame, keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows whose key is one of the distinct keys (by, n), with the key's number in sorted order."""
    ranks = numbered(keys, [F.col(c) for c in by], name)
    return join_spread(rows, ranks, by, [name], "n", [*_DOC, "ln"])


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(did, th, start, len): the shortest runs of repeated lines with min_words words from and up to each line."""
    doc = Window.partitionBy(*_DOC).orderBy("ln")
    t = lines.withColumn("isle", F.col("ln") - F.row_number().over(doc))
    isle = Window.partitionBy(*_DOC, "isle")
    t = t.withColumn("at", F.sum("w").over(isle.orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    ends = t.groupBy(*_DOC, "isle").agg((F.max("ln") + 1).alias("ln"), F.sum("w").alias("at"))
    marks = t.select(*_DOC, "isle", "ln", "at").unionByName(ends)  # bounds between lines, and the words before each
    marks = marks.withColumn("back", -F.col("at"))
    end = F.min("ln").over(isle.orderBy("back").rangeBetween(Window.unboundedPreceding, -min_words))
    start = F.max("ln").over(isle.orderBy("at").rangeBetween(Window.unboundedPreceding, -min_words))
    marks = marks.select(*_DOC, "ln", end.alias("end"), start.alias("start"))
    both = F.array(F.struct(F.col("ln").alias("start"), F.col("end")), F.struct(F.col("start"), F.col("ln").alias("end")))
    runs = marks.select(*_DOC, F.explode(both).alias("r")).where("r.start is not null and r.end is not null")
    return runs.select(*_DOC, "r.start", (F.col("r.end") - F.col("r.start")).alias("len")).distinct()


def suffix_ranks(lines: DataFrame, levels: int) -> DataFrame:
    """lines with r0 .. r{levels}: the rank of each suffix by its first 2^k lines, null where that is unique.

    Ordered by the last rank that isn't null, a position's place in the suffix array."""
    for k in range(1, levels + 1):
        step = 1 << (k - 1)
        doc = Window.partitionBy(*_DOC).orderBy("ln").rangeBetween(step, step)
        pairs = lines.withColumn("x", F.col(f"r{k - 1}")).withColumn("y", F.max(f"r{k - 1}").over(doc))
        many = pairs.where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        ranked = _ranked(pairs.where("x is not null and y is not null").select(*_DOC, "ln", "x", "y"), many, ["x", "y"], f"r{k}")
        lines = stored(lines.join(ranked.select(*_DOC, "ln", f"r{k}"), [*_DOC, "ln"], "left"), "suffixes")
    return lines


def later_copies(lines: DataFrame, min_words: int) -> DataFrame:
    """(did, th, start, len): runs that repeat an earlier one, which they don't overlap."""
    runs = stored(shortest_runs(lines, min_words), "runs")
    longest = runs.agg(F.max("len")).first()[0] or 1
    levels = longest.bit_length() - 1
    ranks = suffix_ranks(lines, levels)
    level = F.floor(F.log2(F.col("len").cast("double"))).cast("int")
    # where a power of two is reached, floating point must not fall short of it
    level = F.when(F.call_function("shiftleft", F.lit(1), level + 1) <= F.col("len"), level + 1).otherwise(level)
    runs = runs.withColumn("k", level).withColumn("tail", F.col("start") + F.col("len") - F.call_function("shiftleft", F.lit(1), F.col("k")))
    rank = F.array(*[F.col(f"r{k}") for k in range(levels + 1)])
    heads = ranks.select(*_DOC, F.col("ln").alias("start"), rank.alias("heads"))
    tails = ranks.select(*_DOC, F.col("ln").alias("tail"), rank.alias("tails"))
    named = runs.join(heads, [*_DOC, "start"]).join(tails, [*_DOC, "tail"])
    named = named.select(*_DOC, "start", "len", F.element_at("heads", F.col("k") + 1).alias("x"), F.element_at("tails", F.col("k") + 1).alias("y"))
    named = stored(named.where("x is not null and y is not null"), "named")
    first = F.min(F.struct("did", "th", "start")).alias("first")
    intervals = stored(named.groupBy("len", "x", "y").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"), "intervals")
    later = join_spread(named, intervals, ["len", "x", "y"], ["first"], "n", [*_DOC, "start"])
    same = (F.col("did") == F.col("first.did")) & (F.col("th") == F.col("first.th"))
    return later.where(~same | (F.col("first.start") + F.col("len") <= F.col("start"))).select(*_DOC, "start", "len")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the text that is left, and the names of two more columns: lines, and lines deleted."""
    lines = stored(repeated_lines(docs, id_col, text_col), "lines")
    later = later_copies(lines, min_words)
    gone = later.select(*_DOC, F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("ln"))
    gone = gone.groupBy(*_DOC).agg(F.array_sort(F.collect_set("ln")).alias("gone"))
    before = F.concat(F.array(F.lit(-1)), F.slice("gone", 1, F.size("gone") - 1))
    mask = F.flatten(F.zip_with("gone", before, lambda x, y: F.concat(F.array_repeat(F.lit(False), (x - y - 1).cast("int")), F.array(F.lit(True)))))
    gone = stored(gone.select(*_DOC, F.size("gone").alias("n"), mask.alias("gone")), "gone")  # for each line up to the last that goes
    g, d, t, n, m = (own_name(docs, x) for x in ("gone", "did", "th", "n_lines", "n_deleted"))
    gone = gone.select(F.col("did").alias(d), F.col("th").alias(t), F.struct("n", "gone").alias(g))
    did, th = _keys(docs, id_col, text_col)
    out = docs.withColumns({d: did, t: th}).join(gone.hint("merge"), [d, t], "left")
    kept = F.array_join(F.filter(_lines(F.col(text_col)), lambda x, i: ~F.coalesce(F.get(F.col(f"{g}.gone"), i), F.lit(False))), "\n")
    left = F.when(F.col(g).isNull(), F.col(text_col)).otherwise(kept)
    lines_of = F.when(F.col(text_col).isNull() | (F.col(text_col) == ""), 0).otherwise(F.size(_lines(F.col(text_col))))
    out = out.select(
        *[left.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        lines_of.cast("long").alias(n),
        F.coalesce(F.col(f"{g}.n"), F.lit(0)).cast("long").alias(m),
    )
    return out, n, m
