"""The operators against brute force and over odd rows: nulls, empty and long texts, ties, repeats, no rows."""

import hashlib
import random
import re
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tidelode.llm import chat_format, common, components, decontaminate, exact_dedup, line_dedup, mixing, ngram_join, quality, token_counts, url_filter, warc

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, "word " * 30_000), (6, "É é A a"), (7, "a\tb\n\nc"), (8, "a b c")]


def some_texts(n, seed, vocabulary=40, copies=0.5):
    """Texts of which many are edited copies of earlier ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < copies:
            w = rng.choice(out)[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
            out.append((i, " ".join(w)))
        else:
            out.append((i, " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 60)))))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# exact dedup


@pytest.mark.parametrize("rows", [ODD, some_texts(60, 1), []])
def test_exact_dedup(spark, rows):
    got = [tuple(r) for r in exact_dedup.dedup(docs_of(spark, rows)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r[0], r[1], r[2], r[4]) for r in got], key=key) == sorted(brute.exact_dedup(rows), key=key)
    kept = [r for r in got if r[3]]
    assert len({r[4] for r in kept}) == len(kept) and {r[4] for r in kept} == {r[4] for r in got}


def test_exact_dedup_appends_what_is_new(spark):
    index = exact_dedup.DigestIndex(spark, "t_index", 4)
    exact_dedup.dedup(docs_of(spark, [(5, "a b"), (6, "c")]), index)
    second = exact_dedup.DigestIndex(spark, "t_index", 4)
    rows = {r["doc_id"]: r for r in exact_dedup.dedup(docs_of(spark, [(1, "a  b"), (2, "d")]), second).collect()}
    assert rows[1]["keep_id"] == 5 and not rows[1]["kept"] and rows[2]["kept"]
    assert second.table().count() == 3
    rows = exact_dedup.digests(docs_of(spark, [(9, "d")]))
    assert second.add(rows).count() == 0
    plan = rows.hint("merge").join(second.table(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(digest") <= 1  # none on the index side


def test_exact_dedup_counts_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, "t_counts", 4)
    exact_dedup.dedup(docs_of(spark, [(5, "a b"), (5, "a b"), (6, "c")]), index)
    rows = sorted(map(tuple, exact_dedup.dedup(docs_of(spark, [(5, "a b"), (7, "a  b"), (8, "d")]), index).drop("text_sha256").collect()))
    assert rows == [(5, 5, 4, False), (7, 5, 4, False), (8, 8, 1, True)]
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.dedup(docs_of(spark, ODD)).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_digest_index_reopens_with_other_shuffle_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    exact_dedup.dedup(docs_of(spark, [(5, "a b"), (6, "c")]), exact_dedup.DigestIndex(spark, "t_reopen", 4, path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        again = exact_dedup.DigestIndex(spark, "t_reopen", path=path)
        assert again.buckets == 4
        rows = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.dedup(docs_of(spark, [(1, "a b"), (2, "d")]), again).collect()}
        assert rows == {1: (5, False), 2: (2, True)}
        spark.sql("DROP TABLE t_reopen")  # another session knows the files alone
        again = exact_dedup.DigestIndex(spark, "t_reopen_2", 9, path)
        assert again.buckets == 4 and again.table().count() == 3
        rows = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(docs_of(spark, [(1, "d"), (3, "e")]), again).collect()}
        assert rows == {1: (2, 2, False), 3: (3, 1, True)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_digest_index_repeats_a_batch(spark):
    index = exact_dedup.DigestIndex(spark, "t_repeat", 4)
    batches = {"x": [(5, "a b"), (5, "a b"), (6, "c"), (7, None)], "y": [(1, "a b"), (2, "d")]}
    said = lambda b: sorted(map(repr, exact_dedup.dedup(docs_of(spark, batches[b]), index, batch=b).collect()))
    first = {b: said(b) for b in batches}
    rows = spark.table("t_repeat").count()
    assert said("x") == first["x"] and said("y") == first["y"] and said("x") == first["x"]
    assert spark.table("t_repeat").count() == rows
    assert sum("kept=True" in r for r in first["x"]) == 3 and sum("kept=True" in r for r in first["y"]) == 1
    # a batch of which a part was appended before the driver was lost
    part = exact_dedup.digests(docs_of(spark, [(8, "e")]))
    index.add(part, "z")
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(docs_of(spark, [(8, "e"), (9, "f"), (10, "d")]), index, batch="z").collect()}
    assert rows == {8: (8, 1, True), 9: (9, 1, True), 10: (2, 2, False)}


def test_hot_keys_are_spread(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, 1).when(F.col("id") < 3010, None).otherwise(F.col("id") % 100 + 2).cast("long").alias("k"))
    table = rows.where("k is not null and k <> 50").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 10)
    for how in ("inner", "left"):
        got = common.join_spread(rows, table, ["k"], ["v"], "n", ["id"], how)
        want = rows.join(table.select("k", "v"), "k", how)
        assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, want.select("id", "k", "v").collect()))


# decontamination


def test_decontaminate_matches_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(6)}" for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 11, 25])))) for i in range(12)] + [(99, None), (100, "w1 w1"), (101, "W1, w1!")]
    docs = [(i, " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 50)))) for i in range(25)]
    for i in range(25, 40):
        docs.append((i, "Zero " + (rng.choice(items)[1] or "") + ". End " + (rng.choice(items)[1] or "").upper()))
    docs += [(50, None), (51, ""), (52, "...")]
    found = decontaminate.decontaminate(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()}
    assert got == brute.decontaminate(docs, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in found.collect())


def test_decontaminate_in_blocks_and_odd_rows(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"a{i}b{j}" for j in range(12))) for i in range(9)] + [(9, "one")], "item_id long, text string")
    docs = docs_of(spark, [*ODD, (20, "x " + " ".join(f"a3b{j}" for j in range(12)))])
    whole = sorted(map(str, decontaminate.decontaminate(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 4)
    assert sorted(map(str, decontaminate.decontaminate(docs, items).collect())) == whole
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.count() == len(ODD) + 1 - 4 and clean.columns == ["doc_id", "text"]
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


@pytest.mark.parametrize(("block_rows", "key_rows", "hot_share"), [(3, 5, 1024), (0, 1000, 1024), (0, 2, 3)])
def test_decontaminate_many_windows(spark, monkeypatch, block_rows, key_rows, hot_share):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))) for _ in range(30)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(50, "w1 w2"), (51, "w3"), (52, None)], "item_id long, text string")
    rows = [(i, " ".join([rng.choice(texts), rng.choice(words), rng.choice(texts)])) for i in range(40)] + [*ODD, (70, "w3"), (70, "w3"), (71, "w1 w2")]
    docs = docs_of(spark, rows)
    whole = sorted(map(str, decontaminate.decontaminate(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(decontaminate, "KEY_ROWS", key_rows)
    monkeypatch.setattr(decontaminate, "HOT_SHARE", hot_share)
    assert sorted(map(str, decontaminate.decontaminate(docs, items).collect())) == whole


def test_decontaminate_keeps_every_row(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x y")], "item_id long, text string")
    rows = [(1, "x y"), (1, "x y"), (1, "other"), (None, "x y"), (2, None)]
    got = sorted((tuple(r) for r in decontaminate.decontaminate(docs_of(spark, rows), items).collect()), key=str)
    hit = lambda i: (i, 2, 2, 1, ["2"], True)
    assert got == sorted([hit(1), hit(1), hit(None), (1, 1, 0, 0, [], False), (2, 0, 0, 0, [], False)], key=str)


# line dedup


@pytest.mark.parametrize("seed", range(6))
def test_line_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"l{i}w{j}" for j in range(rng.randrange(1, 6))) for i in range(12)]
    docs = []
    for d in range(14):
        ls = []
        for _ in range(rng.randrange(0, 12)):
            ls.append(rng.choice(pool) if rng.random() < 0.8 else rng.choice(["", "  ", f"own{d}x{len(ls)}"]))
        docs.append((d, "\n".join(ls)))
    out, lines, deleted = line_dedup.dedup_lines(docs_of(spark, docs), 6)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute.dedup_lines(docs, 6)


def test_line_dedup_odd_rows(spark):
    run = "\n".join("word " * 20 + str(i) for i in range(4))
    rows = [*ODD, (30, run), (31, "own\n" + run + "\nown"), (32, run)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], DOCS + ", n_lines string")
    out, n, m = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", n, m] and n != "n_lines"
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[30]["text"] == run and got[31]["text"] == "own\nown" and got[32]["text"] == "" and got[31][m] == 4
    assert got[1]["text"] is None and got[7]["text"] == "a\tb\n\nc"
    assert line_dedup.dedup_lines(docs.limit(0))[0].count() == 0


def test_line_dedup_of_copies(spark):
    run = "\n".join("word " * 20 + str(i) for i in range(4))
    own = "\n".join("own " * 20 + str(i) for i in range(4))
    rows = [(4, run), (4, run), (5, run + "\nmore"), (6, run), (6, run), (7, own), (7, own), (7, "other")]
    out, _, m = line_dedup.dedup_lines(docs_of(spark, rows))
    want = [(4, run, 0), (4, run, 0), (5, "more", 4), (6, "", 4), (6, "", 4), (7, "other", 0), (7, own, 0), (7, own, 0)]
    assert sorted((r["doc_id"], r["text"], r[m]) for r in out.collect()) == want


def test_suffix_ranks_are_a_suffix_array(spark):
    seq = [3, 1, 2, 1, 2, 1, 2, 3, 1, 2]
    docs = docs_of(spark, [(0, "\n".join(f"line{x} a b" for x in seq))])
    lines = line_dedup.repeated_lines(docs, "doc_id", "text")
    rows = line_dedup.suffix_ranks(lines, 2).orderBy("ln").collect()
    by_id = {r["ln"]: r["r0"] for r in rows}
    for k in (1, 2):
        have = {r["ln"]: r[f"r{k}"] for r in rows if r[f"r{k}"] is not None}
        for a in have:
            for b in have:
                x, y = ([by_id[i] for i in range(s, s + 2**k)] for s in (a, b))
                assert (have[a] < have[b]) == (x < y)


# n-gram join


@pytest.mark.parametrize("seed", range(4))
def test_links_match_brute_force(spark, seed):
    rows = some_texts(120, seed, copies=0.7) + [(1000 + a, b) for a, b in enumerate(["x", "x", "X", "x y", "", None, "x y z"])]
    got = sorted(tuple(r) for r in ngram_join.link_classes(docs_of(spark, rows)).collect())
    assert got == sorted(brute.link_classes(rows))


def test_links_near_the_threshold(spark):
    base = [f"t{i}" for i in range(103)]
    rows = [(0, " ".join(base))] + [(k, " ".join([*base[: 103 - k], *[f"n{k}x{i}" for i in range(k)]])) for k in range(1, 20)]
    got = sorted(tuple(r) for r in ngram_join.link_classes(docs_of(spark, rows)).collect())
    assert got == sorted(brute.link_classes(rows))
    got = sorted(tuple(r) for r in ngram_join.link_classes(docs_of(spark, rows), 5, 80, 100).collect())
    assert got == sorted(brute.link_classes(rows, 5, 80))


def test_links_of_odd_rows(spark):
    got = sorted((tuple(r) for r in ngram_join.link_classes(docs_of(spark, ODD)).collect()), key=str)
    assert got == sorted(brute.link_classes(ODD), key=str)
    assert ngram_join.link_classes(docs_of(spark, [])).count() == 0
    kept = [r["doc_id"] for r in ngram_join.keep_one(docs_of(spark, ODD)).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, None, None, 5, 6, 7], key=str)  # "a b c" twice, the row (4, "one") twice


def test_keep_one_of_equal_ids(spark):
    a, b = "one two three four five six", "other words of another kind altogether here"
    docs = spark.createDataFrame([(1, a, 0), (2, a, 1), (2, b, 2), (2, b, 3), (3, b + " x", 4), (3, "", 5)], "doc_id long, text string, key int")
    out = ngram_join.keep_one(docs, 1, 80, 100)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, a), (2, b), (3, "")]
    rows = {tuple(r) for r in ngram_join.link_classes(docs.select("doc_id", "text"), 1, 80).collect()}
    assert rows == {(1, 6, 1), (2, 6, 1), (2, 7, 2), (3, 8, 2), (3, 0, 3)}


def test_shared_passages_make_no_pairs(spark, monkeypatch):
    """Groups of two copies and a near copy, all with one licence: pairs grow with the documents, not with their square."""
    monkeypatch.setattr(ngram_join, "MEMBERS", 16)
    links, pairs = ngram_join._links, []
    monkeypatch.setattr(ngram_join, "_links", lambda blocks, p, *more: (pairs.append(p.count()), links(blocks, p, *more))[1])
    licence = " ".join(f"licence{i}" for i in range(120))
    made = []
    for n in (150, 600):
        rows = []
        for i in range(n):
            own = [f"g{i // 3}w{j}" for j in range(80)]
            if i % 3 == 2:
                own[0] = "edited"
            rows.append((i, " ".join(own) + " " + licence))
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_classes(docs_of(spark, rows)).collect()}
        assert got == {i: i - i % 3 for i in range(n)}
        made.append(sum(pairs))
        pairs.clear()
    assert made[1] <= 4 * made[0] + 10 and made[1] <= 600


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in ngram_join.link_classes(docs_of(spark, rows)).collect())
    assert got == sorted(brute.link_classes(rows))


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# URLs


def fits(host, path, h, p):
    return (host == h or host.endswith("." + h)) and path.startswith(p)


def test_url_filter_matches_brute_force(spark):
    rng = random.Random(8)
    names = ["a", "b", "com", "org", "a.com", "b.org", "x.a.com"]
    paths = ["", "/", "/en", "/en/", "/de/7"]
    rules = sorted({(rng.choice(names), rng.choice(paths)) for _ in range(20)})
    rules = [(h, p, "block" if i % 2 else "allow") for i, (h, p) in enumerate(rules)]
    urls = [f"{rng.choice(['http://', 'https://', ''])}{rng.choice(['', 'w.', 'X.A.'])}{rng.choice(names).upper()}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#/de/', '77'])}" for _ in range(200)]
    urls += [None, "", "://", "http://", "no scheme", "http://a.com?x", urls[0]]
    got = url_filter.judge(spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = {r["page_id"]: r for r in got.collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].lower(), m[2]
        found = [(len(h + p), h + p, v) for h, p, v in rules if fits(host, path, h, p)]
        best = max(found, default=(0, None, "allow"))
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, best[1], best[2])


def test_url_filter_probes_before_it_moves_and_spreads_hot_rules(spark, monkeypatch):
    urls = [f"https://h{i}.com/en/{i % 50}" for i in range(400)] + [f"http://x{i}.org/a" for i in range(200)] + ["http://deep.a.net/b/c", None]
    rules = [("com", "/", "block"), ("h7.com", "/en/7", "allow"), ("h7.com", "/en/7", "block"), ("a.net", "/b", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(map(tuple, url_filter.judge(pages, listed).collect()), key=str)
    assert sum(r[-1] == "block" for r in want) == 401 and (7, urls[7], "h7.com", "/en/7", "h7.com/en/7", "block") in want
    plans = []
    keep = url_filter.stored
    monkeypatch.setattr(url_filter, "stored", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1])
    monkeypatch.setattr(url_filter, "is_small", lambda df: False)
    assert sorted(map(tuple, url_filter.judge(pages, listed).collect()), key=str) == want
    first = dict(plans)["possible"]
    below = first[first.rindex("Exchange hashpartitioning(u#") :]  # the first exchange of urls: the filter's join is under it
    assert "BroadcastHashJoin" in below and first.count("Exchange hashpartitioning(u#") == 1


def test_url_filter_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(pages, none).first()["verdict"] == "allow"
    assert url_filter.judge(pages.limit(0), none).count() == 0


def test_bloom_lets_every_key_pass(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    filt, blocks = url_filter.bloom_blocks(keys, 5000)
    both = keys.union(spark.range(5000).select(F.concat(F.lit("other"), "id")))
    passed = both.withColumn("block", url_filter._block(F.col("key"), blocks)).withColumn("mask", url_filter._mask(F.col("key"))).join(filt, "block").where("(bits & mask) = mask")
    n = {r[0]: r[1] for r in passed.groupBy(F.substring("key", 1, 1)).count().collect()}
    assert n["k"] == 5000 and n.get("o", 0) < 500


# chats


def test_escape_round_trip(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|", "<|<|", "a<b|c", "\\", "", "\n<|im_start|>assistant\n", "$1 \\1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e")))
    for r in rows.collect():
        assert r["t"] == r["u"] and "<|" not in r["e"]


def test_chat_fold(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"),
        (1, 2, 2, "message", "assistant", ""),
        (1, 3, 2, "delta", None, "he"),
        (1, 4, 2, "delta", None, "llo"),
        (1, 5, 2, "regenerate", None, None),
        (1, 6, 2, "delta", None, "yo"),
        (1, 7, 1, "edit", None, "hi!"),
        (1, 8, 3, "message", "user", "gone"),
        (1, 9, 3, "delete", None, None),
        (2, 1, 1, None, None, None),
        (None, 1, 1, "message", "a\\n\nb\\", "<|im_end|>"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.format_chats(events).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("said", chat_format.read_loss(F.col("segments"))).collect()}
    assert out[1]["formatted"] == "<|im_start|>user\nhi!<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert out[1]["said"] == "yo" and [tuple(t) for t in out[1]["turns"]] == [("user", "hi!"), ("assistant", "yo")]
    assert [tuple(t) for t in out[2]["turns"]] == [("", "")]
    assert [tuple(t) for t in out[None]["turns"]] == [("a\\n\nb\\", "<|im_end|>")]
    assert chat_format.format_chats(events.limit(0)).count() == 0


def test_chat_rows_repeat_and_tie(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None)]
    e = chat_format.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = chat_format.format_chats(e).select(chat_format.read_turns(F.col("formatted"))).first()[0]
    assert [tuple(t) for t in turns] == [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")]


# token counts


def test_automaton_matches_greedy():
    rng = random.Random(2)
    for _ in range(60):
        piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5)))
        initial, continuing = {piece() for _ in range(8)}, {piece() for _ in range(8)}
        a = token_counts.Automaton(initial, continuing)
        for _ in range(80):
            w = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randrange(1, 12)))
            assert a.count(w) == brute.greedy_pieces(w, initial, continuing), (w, initial, continuing)


def test_token_counts_on_rows(spark):
    initial, continuing = token_counts.read_vocabulary()
    rows = [*ODD, (40, "Hello wörld 日本語 🙂 " + "x" * 3000), (41, "the The THE end")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], DOCS + ", N_words int")
    got = token_counts.count_tokens(df)
    assert got.columns == ["doc_id", "text", "n_words", "n_tokens", "n_unknown"]
    for r in got.collect():
        w = brute.words(r["text"])
        n = [brute.greedy_pieces(x.encode(), initial, continuing) for x in w if len(x) < 5000]
        assert r["n_words"] == len(w) and r["n_unknown"] == sum(x < 0 for x in n) and r["n_tokens"] == sum(abs(x) for x in n)
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_line_dedup_of_many_deleted_lines(spark):
    body = "\n".join(f"line {i} of a text that comes twice as one long run" for i in range(3000))
    rows = [(1, body), (2, f"own\n{body}\nend")]
    start = time.time()
    out, _, deleted = line_dedup.dedup_lines(docs_of(spark, rows))
    got = {r["doc_id"]: (r["text"], r[deleted]) for r in out.collect()}
    assert got == {1: (body, 0), 2: ("own\nend", 3000)} and time.time() - start < 300


# archives


def test_record_round_trip():
    for page, url, body, refers in [(1, "http://a/é b\r\nX: y%20", b"<p>\r\n\r\n", None), (None, None, b"", None), (3, "u", b"long", 1)]:
        digest = warc.payload_digest(body)
        r = warc.parse(warc.record(page, url, body, digest, len(body), refers))
        assert (r["page_id"], r["url"], r["payload_digest"], r["payload_bytes"], r["refers_to"]) == (page, url, digest, len(body), refers)
        assert r["payload"] == (b"" if refers else body) and r["record_type"] == ("revisit" if refers else "response")


def test_archive_round_trip(spark):
    pages = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "x", ""), (5, "y", "é" * 100_000), (6, "z", "same"), (None, "n", "same")]
    df = spark.createDataFrame([(a, b, c, "ignored") for a, b, c in pages], "page_id long, url string, html string, offset string").repartition(3)
    folder = warc.archive_folder(spark)
    index = warc.write_archive(df, folder)
    rows = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    assert len(rows) == len(pages)
    for page, url, html in pages:
        body = (html or "").encode()
        r = rows[page]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == warc.payload_digest(body) and r["url"] == url
    assert [rows[i]["refers_to"] for i in (1, 2, 3, 4, 5, 6, None)] == [6, 6, 4, None, None, None, None]
    assert bytes(rows[5]["payload"]) == ("é" * 100_000).encode() and rows[2]["record_type"] == "revisit"
    some = warc.read_records(index.where("page_id in (2, 6)"), folder)
    assert sorted(r["page_id"] for r in some.collect()) == [2, 6]
    index = warc.write_archive(df, warc.archive_folder(spark), least=5)
    assert index.where("record_type = 'revisit'").count() == 0
    assert warc.read_records(warc.write_archive(df.limit(0), folder), folder).count() == 0


def test_archives_share_a_folder(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/archives"
    (tmp_path / "archives").mkdir()
    (tmp_path / "archives" / "notes.txt").write_text("mine")
    pages = [[(10 * k + i, "u", f"page {i % 7}" if i < 9 else f"page {k} {i}") for i in range(12)] for k in range(2)]
    frames = [spark.createDataFrame(p, "page_id long, url string, html string") for p in pages]
    first = warc.write_archive(frames[0], folder)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)  # payloads that repeat come by a shuffle
    second = warc.write_archive(frames[1], folder)
    assert (tmp_path / "archives" / "notes.txt").read_text() == "mine"
    for index, rows in ((first, pages[0]), (second, pages[1])):
        got = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
        last = {}
        for page, _, html in rows:
            last[html] = max(last.get(html, 0), page)
        assert {p: r["refers_to"] for p, r in got.items()} == {p: None if last[h] == p else last[h] for p, _, h in rows}
        assert {p: bytes(r["payload"]).decode() for p, r in got.items() if r["refers_to"] is None} == {p: h for p, _, h in rows if last[h] == p}


# mixing


def targets_by_hand(sizes, epochs=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    cap = {s: most * n for s, n in sizes.items()}
    out, left, free = dict.fromkeys(sizes, 0.0), epochs * sum(sizes.values()), set(names)
    while free and left > 1e-9:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] >= cap[s]}
        if not over:
            for s in free:
                out[s] = share * w[s]
            break
        for s in over:
            out[s] = cap[s]
        left -= sum(cap[s] for s in over)
        free -= over
    return out


def test_mix(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.randrange(0, 200))), rng.choice(["a", "b", "b", "b", "ü", None, "z"])) for i in range(600)]
    rows += [(600, None, "a"), (601, "", "a"), (602, " ", "empty")]
    df = spark.createDataFrame(rows, DOCS + ", source string")
    m = mixing.Mix(df, block_words=16)
    got = m.taken().collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = targets_by_hand(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 40)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.Mix(df.repartition(7), block_words=16).taken().collect()), key=str)
    slots = m.slots().collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    assert m.texts().count() == len(slots) and m.texts().agg(F.sum(common.count_words(F.col("text")))).first()[0] == sum(taken.values())


def test_mix_draws_shard_counts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 64)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 500)
    df = spark.createDataFrame([(i, "w " * 128, "abc"[i % 3]) for i in range(900)], DOCS + ", source string")
    m = mixing.Mix(df, block_words=16)
    rows = m.slots().orderBy("shard", "slot").collect()
    n = len(rows)
    assert [r["shard"] * 64 + r["slot"] for r in rows] == list(range(n))
    counts = {(r["shard"], r["source"]): r["slots"] for r in m.shard_counts().collect()}
    shards = n // 64
    for s in "abc":
        mine = [r for r in rows if r["source"] == s]
        assert sum(c for (_, x), c in counts.items() if x == s) == len(mine)
        p = len(mine) / n
        spread = sum((counts.get((i, s), 0) - 64 * p) ** 2 for i in range(shards)) / (64 * p * (1 - p) * (n - 64) / (n - 1))
        assert abs(spread - shards) < 4 * (2 * shards) ** 0.5  # as many as drawn; an even deal has far less
        blocks = 300 * 128 // 16
        assert len({r["block"] for r in mine[:blocks]}) == min(blocks, len(mine))  # numbered from shard to shard
    assert counts != {(r["shard"], r["source"]): r["slots"] for r in mixing.Mix(df, block_words=16, seed=18).shard_counts().collect()}
    assert "shard" in m.taken()._jdf.queryExecution().optimizedPlan().toString()


def test_mix_keeps_texts_of_equal_id(spark):
    df = spark.createDataFrame([(1, "a " * 32, "s"), (1, "b " * 32, "s"), (1, "b " * 32, "s"), (2, "c " * 32, "s")], DOCS + ", source string")
    whole = mixing.Mix(df, block_words=16, epochs=2.0).texts().collect()
    words = [w for r in whole for w in r["text"].split()]
    assert {w: words.count(w) for w in "abc"} == {"a": 64, "b": 128, "c": 64}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], DOCS + ", source string")
    assert mixing.Mix(df).taken().count() == 0
    df = spark.createDataFrame([(1, None, None), (1, "", None)], DOCS + ", source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.Mix(df).taken().collect()] == [(0, 0.0, 0)] * 2


def test_permutations_are_permutations(spark):
    for n in (1, 2, 3, 30, 97, 1000, 4096):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long")).withColumn("seed", F.xxhash64(F.lit(n)))
        got = [r[0] for r in df.orderBy("id").select(mixing.permuted(F.col("id"), F.col("n"), F.col("seed"))).collect()]
        assert sorted(got) == list(range(n)) and got == brute.permutation(n, brute.xx64(("int", n)))
    steps = {(b - a) % n for a, b in zip(got, got[1:], strict=False)}
    assert len(steps) > n / 2  # an affine map has one step; of n random ones 63 % differ
    up = sum(a < b for a, b in zip(got, got[1:], strict=False))
    assert abs(up - n / 2) < 5 * (n / 12) ** 0.5


def test_mix_matches_brute_force(spark, monkeypatch):
    """Every step again in plain Python, with the same hashes: what is taken, and the text of each slot."""
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 16)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rng = random.Random(11)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(rng.randrange(0, 90))), rng.choice(["a", "b", "b", "b", "ü", None])) for i in range(150)]
    m = mixing.Mix(spark.createDataFrame(rows, DOCS + ", source string"), block_words=16)
    taken, slots = brute.mix(rows, 16, 16, 20)
    assert {r["doc_id"]: r["taken"] for r in m.taken().collect()} == taken
    got = {(r["shard"], r["slot"]): (r["source"], r["text"]) for r in m.texts().collect()}
    assert got == slots
    for r in m.texts().collect():
        assert r["doc_ids"] == list(dict.fromkeys(int(w[1:].split("w")[0]) for w in r["text"].split()))


# quality


def test_quality_learns_and_scores_odd_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        w = [rng.choice("alpha beta gamma delta".split()) for _ in range(40)]
        rows.append((i, " ".join(w if good else [x + "###" for x in w])))
        labels.append((i, int(good)))
    labels += [(1, None), (9999, 1), (None, 1)]
    docs = docs_of(spark, rows + [(1000 + i, t) for i, (_, t) in enumerate(ODD)])
    docs = docs.withColumn("score", F.lit("mine"))
    out, name = quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert name == "_score" and out.count() == 300 + len(ODD)
    got = {r["doc_id"]: r[name] for r in out.collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == bool(q) for i, q in labels[:300]) > 290
    again = {r["doc_id"]: r[name] for r in quality.score_documents(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int"))[0].collect()}
    assert again == pytest.approx(got, abs=1e-9)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored, name = quality.score_documents(docs.select("doc_id", "text"), labels)
    rows = scored.where(quality.held_out(F.col("doc_id"))).join(labels.where("quality is not null"), "doc_id").select(name, "quality").collect()
    good, bad = ([r[0] for r in rows if r[1] == q] for q in (1, 0))
    assert len(good) > 30 and len(bad) > 5
    assert sum((r[0] >= quality.THRESHOLD) == bool(r[1]) for r in rows) / len(rows) >= 0.95
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) >= 0.98


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out, name = quality.score_documents(docs_of(spark, ODD), none)
    assert {r[name] for r in out.collect()} == {0.5}
    out, name = quality.score_documents(docs_of(spark, [(1, "a"), (2, "b"), (3, "c")]), spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, quality int"))
    assert {r[name] for r in out.collect()} <= {1.0, 0.5}
    assert quality.score_documents(docs_of(spark, []), none)[0].count() == 0


def test_held_out_is_crc32(spark):
    import zlib

    got = {r[0]: r[1] for r in spark.range(200).select("id", quality.held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


CLASH = ["key", "th", "id", "n", "w", "rows", "salt", "gone", "counts", "listed_url", "listed_rule", "page", "score", "start", "__gone", "__url", "__rule", "__said", "__counts", "block", "size", "copies"]


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_clashing_names(spark, name):
    """Columns of one's own, whatever their names, change nothing."""
    more = lambda df: df.withColumns({c: F.lit("mine") for c in CLASH if c not in df.columns})
    docs = spark.createDataFrame([(1, "a b c d", "s"), (2, "a b c d", None), (3, None, "s")], DOCS + ", source string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    pages = spark.createDataFrame([(1, "http://a.com/x", "h"), (2, None, "h")], "page_id long, url string, html string")
    rules = spark.createDataFrame([("a.com", "/", "block")], "host string, path string, verdict string")
    chats = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")

    def archive(df):
        folder = warc.archive_folder(spark)
        return warc.read_records(warc.write_archive(df, folder), folder)

    run, df = {
        "op1": (lambda d: decontaminate.drop_contaminated(d, items), docs), "op2": (lambda d: quality.keep_good(d, labels), docs), "op3": (lambda d: url_filter.judge(d, rules), pages),
        "op4": (lambda d: line_dedup.dedup_lines(d)[0], docs), "op5": (lambda d: chat_format.format_chats(chat_format.events_of(d)), chats), "op6": (token_counts.count_tokens, docs),
        "op7": (ngram_join.keep_one, docs), "op8": (archive, pages), "op9": (lambda d: mixing.Mix(d).taken(), docs), "op10": (exact_dedup.dedup, docs),
    }[name]
    want, got = run(df), run(more(df))
    names = [c for c in want.columns if c in got.columns]
    assert set(names) >= set(want.columns) - {"n_lines", "n_deleted"}
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))


def test_sha256_of_empty_list():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
