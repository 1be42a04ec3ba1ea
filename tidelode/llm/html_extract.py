"""Main text of web pages by composite text density.

A page is cut into tags and text, which make a tree as browsers would read it (implied end tags, unclosed and
crossed tags, raw text of scripts and the like). What is named as no part of an article goes: navigation, page
headers and footers, sidebars, forms, scripts, notices, adverts, reader comments, by element, role, or a word of
class or id. Of the rest, every node has a composite text density: characters per tag, times the logarithm of how
little of both are links, to a base that grows with the share of links in the node and in the page. The node with
the greatest sum of its children's densities (a run of text counts as a child) is the core of the article. The
least density on the path from there to the body is the threshold that a block beside the path must reach to
be part of the article as well. Where pages mark articles, sums are compared inside them, and the whole
article around the core is taken.

Cases: null and empty pages, and pages of which nothing is left, give an empty text. Unclosed comments and
scripts end with the page. White space is what Unicode calls so, no-break spaces included. An element named as no
part of an article is kept if it holds all of the page's articles (or headings of first rank, where none is marked)
and over half of its text: a form or a wrapper around everything. In an
article's own header, headings stay. Each row is taken by itself: repeated rows, ties and extra columns
don't matter; columns named like the results are replaced.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\s+|/|[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)?|=)*+)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.IGNORECASE)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_set = lambda s: frozenset(s.split())
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
CELLS = _set("td th caption")
BLOCKS = HEADINGS | CELLS | _set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header"
    " hgroup hr li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul"
)
CONTAINERS = _set("center details div dl fieldset ol section table ul")
#: Starts that end an open paragraph.
_ENDS_P = BLOCKS - _set("html body li dd dt option td th caption tbody tfoot thead tr")
#: Starts that end an open element of these names, no further up than the next of those.
_ENDS = {
    "li": (_set("li"), _set("ul ol menu dir")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")), "option": (_set("option"), _set("select")),
    "tr": (_set("tr td th caption"), _set("table")), "td": (_set("td th"), _set("tr table")), "th": (_set("td th"), _set("tr table")),
    "tbody": (_set("tbody thead tfoot tr td th caption"), _set("table")), "tfoot": (_set("tbody thead tr td th"), _set("table")),
}
#: Never part of an article.
NO_TEXT = _set("head script style noscript template svg canvas audio video object embed iframe textarea title select button input xmp noembed noframes datalist dialog")
NO_ARTICLE = _set("nav footer aside form header menu search")
ROLES = _set("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert status")
#: Words of a class or id that name what is no part of an article.
WORDS = _set(
    "nav navbar navigation topnav subnav menu menubar breadcrumb breadcrumbs masthead header topbar footer footers foot sidebar sidebars aside rail"
    " ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit banner banners sponsor sponsors sponsored promo promos promotion"
    " cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall disclaimer copyright legal"
    " newsletter subscribe subscription signup login signin register search searchbox form share sharing social related recommended recommendations"
    " comment comments commentlist commentary disqus discussion reply replies respond responses pagination pager widget widgets toolbar skip"
)
#: With one of these, "header" names an article's own header.
_OWN = _set("article post entry story content")
#: Before such a word they say that the page has it, elsewhere.
_ELSEWHERE = _set("has have with no without not is hide")
_AFTER = _set("open enabled on off closed allowed")


def _named(value: str) -> str:
    """"part" if one of the names of a class or id has a word of WORDS, "header" if it is an article's own header, else ""."""
    for name in value.split():
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        if parts and parts[0] not in _ELSEWHERE and parts[-1] not in _AFTER and (words := WORDS.intersection(parts)):
            return "header" if words == {"header"} and not _OWN.isdisjoint(parts) else "part"
    return ""


class Page:
    """The tree of a page in arrays, in page order: tag, parent, whether it is kept, and its runs of text (node, block, text, in a link)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.flagged, self.header, self.gone, self.anchor = ["#page"], [-1], [False], [False], [False], [False]
        self.texts: list[tuple[int, int, str, bool]] = []
        self.open, self.count, self.block, self.link = [0], {"#page": 1}, 0, -1
        at = 0
        while (m := _TOKEN.search(source, at)) is not None:
            self._text(source[at : m.start()])
            at, name = m.end(), (m["name"] or "").lower()
            if not name:
                continue
            if m["end"]:
                self._end(name)
            else:
                self._start(name, m["rest"])
                if name in RAW and not m["rest"].endswith("/"):
                    close = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(source, at)
                    at = close.start() if close else len(source)
        self._text(source[at:])

    def _text(self, raw: str) -> None:
        if raw:
            self.texts.append((self.open[-1], self.block, html.unescape(raw), self.link >= 0))

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            self.count[self.tag[node]] -= 1
            if self.tag[node] in BLOCKS:
                self.block += 1
            if node == self.link:
                self.link = -1

    def _find(self, names: frozenset[str], stops: frozenset[str]) -> int:
        """The depth of the innermost open element of these names, 0 if a stop comes first."""
        if any(self.count.get(n) for n in names):
            for depth in range(len(self.open) - 1, 0, -1):
                tag = self.tag[self.open[depth]]
                if tag in names:
                    return depth
                if tag in stops:
                    break
        return 0

    def _start(self, name: str, rest: str) -> None:
        if name in _ENDS_P and (depth := self._find(_set("p"), CELLS)):
            self._pop_to(depth)
        if name in _ENDS:
            while depth := self._find(*_ENDS[name]):
                self._pop_to(depth)
        if name in HEADINGS and self.tag[self.open[-1]] in HEADINGS:
            self._pop_to(len(self.open) - 1)
        if name == "body" and self.count.get("head"):
            self._pop_to(self._find(_set("head"), frozenset()))
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest else {}
        role = values.get("role", "").strip().lower()
        anchor = name in ("article", "main") or role in ("main", "article") or values.get("itemprop") == "articleBody"
        named = "" if name in ("html", "body", "main") else _named(values.get("class", "")) or _named(values.get("id", ""))
        flagged = name in NO_ARTICLE or role in ROLES or named == "part"
        hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true"
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(self.open[-1])
        self.flagged.append(flagged)
        self.header.append(name == "header" or named == "header")
        self.anchor.append(anchor and not flagged)
        self.gone.append(name in NO_TEXT or hidden)
        if name in BLOCKS:
            self.block += 1
        elif name == "br":
            self.texts.append((node, self.block, " ", False))
        if name in VOID:
            return
        self.open.append(node)
        self.count[name] = self.count.get(name, 0) + 1
        if name == "a":
            self.link = node

    def _end(self, name: str) -> None:
        if name == "a":
            self.link = -1
        if name == "p" and not self.count.get("p"):
            self.block += 1
        inline = name not in BLOCKS and name not in NO_TEXT
        stops = BLOCKS if inline else frozenset() if name in _set("table tr tbody thead tfoot html body") else CELLS - {name}
        names = HEADINGS if name in HEADINGS else frozenset((name,))
        if depth := self._find(names, stops):
            self._pop_to(depth)

    def _sums(self, values: list) -> list:
        """Each node's value with all of its descendants'; children come after their parents."""
        out = list(values)
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out

    def _inside(self, of: list[bool]) -> list[bool]:
        out = list(of)
        for node in range(1, len(out)):
            out[node] = out[node] or out[self.parent[node]]
        return out

    def drop_named(self) -> None:
        """What is named as no part of an article goes, but for wrappers of all of the page's articles, and headings in an article's own header."""
        never = self._inside(self.gone)
        sizes = self._sums(self._chars(never))
        named = self._inside(self.flagged)
        clean = [a and not f and not g for a, f, g in zip(self.anchor, named, never, strict=True)]
        anchors = clean if any(clean) else [a and not g for a, g in zip(self.anchor, never, strict=True)]
        marked = any(anchors)
        held = self._sums([int(a) for a in (anchors if marked else [t == "h1" for t in self.tag])])
        nested = self._inside(anchors)
        own = [h and (n or t != "header") for h, n, t in zip(self.header, nested, self.tag, strict=True)]
        for node in range(1, len(self.tag)):
            wraps = 0 < held[0] == held[node] and 2 * sizes[node] > sizes[0]
            self.gone[node] |= self.flagged[node] and not own[node] and not wraps
        self.gone = self._inside(self.gone)
        heading = self._inside([t in HEADINGS for t in self.tag])
        self.out = [g or o and not h for g, o, h in zip(self.gone, self._inside(own), heading, strict=True)]
        self.anchor = [a and not g for a, g in zip(anchors, self.gone, strict=True)]

    def _chars(self, out: list[bool], links: bool = False) -> list[int]:
        chars = [0] * len(self.tag)
        for node, _, text, in_link in self.texts:
            if not out[node] and (in_link or not links):
                chars[node] += len(" ".join(text.split()))
        return chars

    def densities(self) -> tuple[list[float], list[float]]:
        """Every node's density, and the sum of its children's."""
        out = self.out
        chars, links = self._sums(self._chars(out)), self._sums(self._chars(out, links=True))
        tags = self._sums([int(not o) for o in out])
        link_tags = self._sums([int(t == "a" and not o) for t, o in zip(self.tag, out, strict=True)])
        share = links[0] / max(1, chars[0])

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if c == 0:
                return 0.0
            base = math.log(c / max(1, c - lc) * max(1, lc) + share * c + math.e)
            return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / math.log(base)

        own = [density(chars[i], max(1, tags[i] - 1), links[i], link_tags[i]) for i in range(len(out))]
        total = [0.0] * len(out)
        for i in range(1, len(out)):
            total[self.parent[i]] += own[i]
        for node, _, text, in_link in self.texts:
            if not out[node]:
                n = len(" ".join(text.split()))
                total[node] += density(n, 1, n * in_link, int(in_link))
        return own, total

    def main_text(self) -> str:
        self.drop_named()
        own, total = self.densities()
        inside = self._inside(self.anchor)
        body = next((i for i, t in enumerate(self.tag) if t == "body"), 0)
        nodes = [i for i in range(len(total)) if inside[i] and not self.out[i]] or list(range(len(total)))
        best = max(nodes, key=lambda i: (total[i], -i))
        path = [best]
        while path[-1] > 0:
            path.append(self.parent[path[-1]])
        articles = [i for i in path if self.anchor[i] and self.tag[i] != "main"] or [i for i in path if self.anchor[i]]
        take = [False] * len(total)
        core = articles[-1] if articles else best
        take[core] = True
        on_path = set(path)
        if not articles and body in on_path:
            path = path[: path.index(body) + 1]
        threshold = min(own[i] for i in path)
        before: dict[int, int] = {}
        for i in range(1, len(total)):
            p = self.parent[i]
            if i in on_path:
                if i == core or p in on_path and not articles:
                    j = before.get(p, -1)  # a heading that stands directly before goes with it
                    take[j] = take[j] or j > 0 and self.tag[j] in HEADINGS and not self.out[j]
            elif p in on_path and not articles and p != best and not self.out[i] and own[i] >= threshold > 0:
                take[i] = True
            if not self.out[i]:
                before[p] = i
        take = self._inside(take)
        if core == body and not articles:  # of the body itself, containers under its own density go
            low = self._inside([p == body and own[i] < threshold and self.tag[i] in CONTAINERS for i, p in enumerate(self.parent)])
            take = [t and not x for t, x in zip(take, low, strict=True)]
        blocks: dict[int, list[str]] = {}
        for node, block, text, _ in self.texts:
            if take[node] and not self.out[node]:
                blocks.setdefault(block, []).append(text)
        said = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n\n".join(b for b in said if b)


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extracted(source: Column) -> Column:
    """The main text of a column of pages."""

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return texts(source)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df without its pages, with text and n_chars."""
    kept, own = [c for c in df.columns if c.lower() not in ("text", "n_chars", html_col.lower())], own_name(df, "main_text")
    out = df.select(*kept, extracted(F.col(html_col)).alias(own))
    return out.select(*kept, F.col(own).alias("text"), F.length(own).cast("long").alias("n_chars"))
