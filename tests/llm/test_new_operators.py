"""Fill-in-middle, Merkle manifest and HTML extraction: brute force, round trips, odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelode.llm import fim, html_extract, merkle

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "x"), (4, "one"), (4, "one"), (None, "é"), (None, None), (5, "wörd 🎈 " * 30_000), (6, "É<P>a"), (7, "<<S>"), (8, "a<"), (9, "P>b" * 40), (10, "日本語テキスト" * 9)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle


def fim_brute(doc_id, text):
    text = text or ""
    digest, n = sha(f"1:{'' if doc_id is None else doc_id}"), len(text)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fim(spark):
    rng = random.Random(3)
    rows = ODD + [(100 + i, "".join(rng.choice("ab<>PSM é日🎈\n") for _ in range(rng.choice([1, 2, 7, 63, 64, 65, 511, 513, 2000])))) for i in range(200)]
    made = fim.fim(spark.createDataFrame(rows, DOCS))
    got = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(doc_id, *fim_brute(doc_id, text), text or "") for doc_id, text in rows]
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in got]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(7, "abc", 1, "x", "y")], "doc_id long, text string, N int, whole string, cuts string")
    out = fim.fim(df)
    assert out.columns == ["doc_id", "text", "whole", "cuts", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.first()["n"] == 3 and out.first()["cuts"] == "y"
    assert fim.fim(spark.createDataFrame([], DOCS)).collect() == []


def test_rank_and_select():
    rng = random.Random(5)
    for chars in ("a", "é", "日", "🎈", "aé日🎈"):
        text = "".join(rng.choice(chars) for _ in range(1500))
        data = np.frombuffer(text.encode(), np.uint8)
        starts = [len(text[:k].encode()) for k in range(len(text))]
        b = fim.Boundaries(data)
        assert b.select(np.arange(len(text))).tolist() == starts
        at = np.arange(len(data) + 1)
        assert b.rank(at).tolist() == [sum(1 for s in starts if s < x) for x in at] if len(data) < 2000 else b.rank(np.array([len(data)])).tolist() == [len(text)]
    assert fim.Boundaries(np.zeros(0, np.uint8)).rank(np.array([0])).tolist() == [0]


def test_fim_in_chunks(monkeypatch):
    """Any bytes under one bit vector give the same cuts."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["é日a🎈"[rng.randrange(4)] * rng.randrange(0, 90) for _ in range(80)] + ["", "x" * 5000]
    h1, h2 = (pa.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(2))
    whole = fim._cuts(pa.array(texts), h1, h2)
    monkeypatch.setattr(fim, "CHUNK_BYTES", 64)
    assert fim._cuts(pa.array(texts), h1, h2) == whole
    assert fim._cuts(pa.array(["drop", *texts]).slice(1), h1, h2) == whole


# Merkle manifest


def leaf_brute(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def merkle_brute(rows):
    """rows: (id, source, text); returns (id, leaf, subroot, root, proof digest) of each."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], leaf_brute(row)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(r[1])))
        trees[s] = levels([leaf for _, leaf in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for t, s in enumerate(names):
        for i, (doc_id, leaf) in enumerate(groups[s]):
            proof = ""
            for tree, j in ((trees[s], i), (top, t)):
                for nodes in tree[:-1]:
                    run = 16 * (j // 16)
                    proof += "".join(nodes[run:j] + nodes[j + 1 : run + 16])
                    j //= 16
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], sha(proof)))
    return out


def manifest_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    given = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.unhex(merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.lower("text"))))
    made = merkle.Manifest(df, ["doc_id", "source", "text"], "doc_id", "source", {"given": given})
    hexed = lambda c: merkle.hex_of(F.col(c))
    fold = merkle.folded(merkle.hex_of(F.coalesce("given", "leaf")), F.col("path"))
    return made, made.proofs().select("id", hexed("leaf"), hexed("subroot"), merkle.proof_digest(F.col("path")), fold).collect()


def some_rows(n, sources, seed):
    rng = random.Random(seed)
    return [(rng.choice([i, i, i, None]), sources[min(rng.randrange(len(sources)), rng.randrange(len(sources)))], rng.choice(["A b", "c d", None, "", f"É{i}"])) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        some_rows(700, [None, "", "a", "B", "é", "zz"], 1),
        some_rows(300, [f"s{i}" for i in range(60)], 2),
        some_rows(17, ["one"], 3),
        [(1, "a", "x")],
        [(1, None, "x"), (1, None, "x"), (None, None, None)],
        [(i, "a", "same") for i in range(256)] + [(1, "b", "X")],
    ],
    ids=["hot", "many", "seventeen", "single", "repeats", "full"],
)
def test_manifest(spark, rows):
    made, got = manifest_of(spark, rows)
    want = merkle_brute(rows)
    assert made.root == want[0][3]
    assert sorted((str(r[0]), *r[1:4]) for r in got) == sorted((str(w[0]), w[1], w[2], w[4]) for w in want)
    texts = {leaf_brute(row): row for row in rows}
    for doc_id, leaf, _, _, fold in got:
        text = texts[leaf][2]
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None and text.lower() != text
        assert (fold == made.root) != tampered


def test_manifest_of_no_rows(spark):
    made, got = manifest_of(spark, [])
    assert made.root is None and got == []


def test_manifest_with_many_places_and_rounds(spark, monkeypatch):
    """Places joined by a shuffle and fragments merged two at a time give the same root."""
    rows = some_rows(500, ["a", "b", "c"], 7)
    want = merkle_brute(rows)[0][3]
    monkeypatch.setattr(merkle, "is_small", lambda df: False)
    monkeypatch.setattr(merkle, "FAN", 2)
    made, got = manifest_of(spark, rows)
    assert made.root == want and len(got) == 500


def test_forest_merges_in_any_order():
    leaves = [sha(str(i)) for i in range(700)]
    nodes = [(0, 0, i, 700, bytes.fromhex(d)) for i, d in enumerate(leaves)]
    random.Random(9).shuffle(nodes)
    parts = []
    for k in range(0, 700, 90):
        f = merkle.Forest(1)
        for n in nodes[k : k + 90]:
            f.add(*n)
        parts.append(f)
    while len(parts) > 1:
        a, b = parts.pop(), parts.pop(0)
        for _, _, *node in a.nodes(0):
            b.add(*node)
        parts.append(b)
    assert parts[0].root[1].hex() == levels(leaves)[-1][0] and not parts[0].open


# HTML extraction

PAGES = {
    "article": (
        '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></ul></nav><!-- ad -->'
        '<div class="ad">Buy</div><article><h1>Ti&eacute;tle</h1><p><b>One &amp; two.<br><p>Three\n  four&nbsp;five.</article><footer>&copy; me</footer>',
        "Tiétle\n\nOne & two.\n\nThree four five.",
    ),
    "no article": (
        '<body><div id="top"><a href=/>Home</a> <a href=/b>About</a></div><div id=main><h1>Title here</h1><p>First paragraph of some length, that says things.</p>'
        '<p>Second paragraph with <a href=x>a link</a> in it &amp; more.</p></div><div class="comments"><p>I disagree with all of this, in a very long comment that goes on and on and on and on and on and on.</p></div>'
        "<div class=footer>&copy; me</div></body>",
        "Title here\n\nFirst paragraph of some length, that says things.\n\nSecond paragraph with a link in it & more.",
    ),
    "form around all": (
        '<body><form id=aspnet><header>Site</header><article><header><h1>T</h1><span>by me</span></header><p>Text &lt;b&gt; x.</p><section class="comments"><article><p>Reader says</p></article></section>'
        "</article><input value=x><button>go</button></form>",
        "T\n\nText <b> x.",
    ),
    "crossed tags": ("<article><b><p>one</b> two</p>three<ul><li>a<li>b</ul><a href=x><p>linked</a> text<p>more text", "one two\n\nthree\n\na\n\nb\n\nlinked text\n\nmore text"),
    "raw text": ('<body><script>var x="<p>no</p>";</script><p>hello<textarea><p>x</textarea> world<!-- <p>c</p> --> !', "hello world !"),
    "quotes": ("<article title='a>b'><p class=it's>it's 1 < 2 and 3 > 2</p>", "it's 1 < 2 and 3 > 2"),
    "wrapper": (
        '<body><div class="page has-sidebar comments-open"><div class="content"><h1>T</h1><p>aaaa bbbb cccc dddd</p><p>ffff gggg hhhh iiii</p></div><div class="sidebar"><p>s</p></div></div>'
        '<div class="cookie-notice">We use cookies</div>',
        "T\n\naaaa bbbb cccc dddd\n\nffff gggg hhhh iiii",
    ),
    "own header": (
        '<body><div class="post"><div class="post-header"><h1>T</h1><span>by x</span></div><p>Para one of the post, long enough.</p><p>Para two of the post.</p></div><div>short</div>',
        "T\n\nPara one of the post, long enough.\n\nPara two of the post.",
    ),
    "only comments marked": ('<body><section class="comments"><article><p>only comments</p></article></section><div><p>Real text of the page that is here.</p><p>Also this one.</p></div>', "Real text of the page that is here.\n\nAlso this one."),
    "one paragraph": ("<body><div>Ad ad</div><div><p>Only one paragraph in the article, but a long one, so it is what counts.</p></div>", "Only one paragraph in the article, but a long one, so it is what counts."),
    "two parts": (f"<body><div><p>{'part one ' * 30}</p><p>{'more ' * 40}</p></div><div><p>{'part two ' * 28}</p></div><div><a href=1>x</a> <a href=2>y</a></div><div>Copyright by me</div>", "\n\n".join([("part one " * 30).strip(), ("more " * 40).strip(), ("part two " * 28).strip()])),
    "cell": ("<body><table><tr><td><a href=1>x</a><td>Long text direct in a cell, quite long indeed.<br><br>Another one follows with <b>bold</b> text.</table>", "Long text direct in a cell, quite long indeed. Another one follows with bold text."),
    "plain text": ("just text &amp more", "just text & more"),
    "unclosed script": ("<article><p>a<script>x", "a"),
    "deep": ("<body>" + "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000, "deep text"),
    "long": ("<article>" + "<p>word word</p>" * 20_000 + "</article>", "\n\n".join(["word word"] * 20_000)),
    "nothing": ("<body><nav>a</nav></body>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    source, want = PAGES[name]
    assert html_extract.main_text(source) == want


def test_extract(spark):
    rows = [(i, "u", s, "clash") for i, (s, _) in enumerate(PAGES.values())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "main_text", "text", "n_chars"]
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()) == [(i, t, len(t)) for i, (_, t) in enumerate(PAGES.values())]
    assert html_extract.extract(df.limit(0)).collect() == []
