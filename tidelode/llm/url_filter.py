"""URL filter: a blocked Bloom filter of the listed URLs passes possible hits to an exact hash join.

A rule is a host and a path prefix; it fits the host, all its subdomains, and every path that starts
with the prefix. Each row's url becomes its host's suffixes whose sizes occur in the list; a filter
of the listed hosts, probed before anything is moved, drops nearly all that no rule names. What is left, each url once, becomes (host suffix, path prefix)
keys of the sizes that occur; the filter of whole rules drops nearly all of them; an exact join on the
whole key removes its false positives; the longest rule wins.

A filter is a table of 64-bit blocks, of which a key uses one. It has at most MAX_BLOCKS blocks
(8 MB), so it can be broadcast however long the list is; a longer list only lets more keys through
to the exact join.

Cases: null url or one without "://" has an empty host and path and fits no rule. Of rules of equal
length the one later in order wins (and block before allow). Repeated rows each get their verdict;
an empty list gives every url the default verdict. Columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, is_small, join_spread, own_name, stored

MAX_BLOCKS = 1 << 20
#: Bits set for a key, all in its block.
PROBES = 4
KEYS_PER_BLOCK = 4


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for k in range(PROBES):
        bit = F.shiftright(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom_blocks(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The filter of the column key as rows (block, bits), and how many blocks it has."""
    blocks = 64
    while blocks < MAX_BLOCKS and blocks * KEYS_PER_BLOCK < n_keys:
        blocks *= 2
    table = keys.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("mask"))
    return table.groupBy("block").agg(F.bit_or("mask").alias("bits")), blocks


def maybe_listed(rows: DataFrame, key: Column, filt: DataFrame, blocks: int, out: str) -> DataFrame:
    """rows with out: whether the filter, broadcast, has all bits of key; false for null."""
    probed = rows.withColumn("probe", key).withColumns({"block": _block(F.col("probe"), blocks), "mask": _mask(F.col("probe"))})
    probed = probed.join(F.broadcast(filt), "block", "left")
    hit = F.col("probe").isNotNull() & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return probed.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(out))


def _possible(rows: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """rows whose column key may be one of keys."""
    filt, blocks = bloom_blocks(keys, n_keys)
    probed = rows.withColumns({"block": _block(F.col("key"), blocks), "mask": _mask(F.col("key"))}).join(F.broadcast(filt), "block")
    return probed.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select(*rows.columns)


def judge(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict.

    rules: (host, path, verdict), host in lower case."""
    rules = rules.select("host", F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), F.col("verdict").alias("said"))
    stats = rules.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("chars"))).first()
    n_rules, labels, chars = stats  # distinct sizes only: at most the labels of a host and the characters of a path
    urls = df.select(F.col(url_col).alias("u")).where(F.col("u").isNotNull()).withColumn("parts", F.split(url_host(F.col("u")), r"\."))
    ints = "array<int>"
    hosts = F.transform(
        F.filter(F.lit(labels).cast(ints), lambda n: n <= F.size("parts")),
        lambda n: F.array_join(F.slice("parts", F.size("parts") - n + 1, n), "."),
    )
    # rows are probed where they lie; only urls of hosts that may be listed are moved
    hosts = _possible(urls.select("u", F.explode(hosts).alias("key")), rules.select(F.col("host").alias("key")), n_rules)
    hosts = hosts.groupBy("u", "key").agg(F.count(F.lit(1)).alias("rows")).withColumn("p", url_path(F.col("u")))
    paths = F.transform(F.filter(F.lit(chars).cast(ints), lambda n: n <= F.length("p")), lambda n: F.substring(F.col("p"), F.lit(1), n))
    keys = hosts.select("u", "rows", F.col("key").alias("h"), F.explode(paths).alias("q")).select("u", "rows", F.concat("h", "q").alias("key"))
    possible = _possible(keys, rules, n_rules)
    listed = rules.groupBy("key").agg(F.max("said").alias("said"))
    if is_small(listed):
        hits = possible.join(F.broadcast(listed), "key")
    else:  # rules that most urls may fit, such as a whole top-level domain's, are spread
        possible = stored(possible, "possible")
        named = stored(possible.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(listed, "key"), "named")
        hits = join_spread(possible, named, ["key"], ["said"], "n", ["u"])
    best = hits.groupBy("u").agg(F.max(F.struct(F.length("key").alias("n"), "key", "said")).alias("best"), F.max("rows").alias("rows"))
    u, rule, said, whole = (own_name(df, x) for x in ("listed_url", "listed_rule", "listed_said", "page"))
    best = stored(best.select(F.col("u").alias(u), F.col("best.key").alias(rule), F.col("best.said").alias(said), "rows"), "verdicts")
    pages = df.select(F.col(url_col).alias(u), F.struct(*df.columns).alias(whole))
    if is_small(best):
        out = pages.join(F.broadcast(best), u, "left")
    else:
        out = join_spread(pages, best, [u], [rule, said], "rows", [u, whole], "left")
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return out.select(
        *[F.col(f"{whole}.{c}") for c in kept],
        F.coalesce(url_host(F.col(u)), F.lit("")).alias("host"),
        F.coalesce(url_path(F.col(u)), F.lit("")).alias("path"),
        F.col(rule).alias("rule"),
        F.coalesce(said, F.lit(default)).alias("verdict"),
    )
