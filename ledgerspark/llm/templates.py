"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: tags, each told apart by the path of elements it opens in, and runs of text between tags, each
told apart by its words and the path it stands in. A token's occurrence vector says how often it occurs in each page of a
host; tokens with one vector form an equivalence class. A class is valid if it holds tags and enough pages have it
(``SUPPORT`` and ``SHARE``); its tags are a part of the host's template, and texts in it belong to the template too: they
come and go with its tags, so they are no content. Classes nest by the paths of their tags (``templates`` lists them). What
stands between template tokens are the slots. A slot of links, over all pages of the host, is a menu. From the other slots,
those outside of elements that name themselves as no content (menus, adverts, forms, comments, see ``ASIDE`` and ``WORDS``)
give the text, from the article or main element alone where a page has one.

Vectors are compared by their support and two sums of 32-bit hashes of (page, count), which Spark adds up in any order, so no
task holds a host: a host with a third of all pages costs one row for each token, host and batch. Texts kept in an article
that repeat on fewer pages than their tags (passages, near copies) have other vectors than these and stay. Hosts with
fewer than ``SUPPORT`` pages have no template; there, the names of elements and a block's own links decide.

Null pages and pages without text give an empty text. Null and malformed urls are one host. Repeated rows are pages of their
own. Unclosed elements end with the page, tags that close nothing are ignored, and very long pages are read in one pass. Other
columns are left out; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, trim

#: Pages of a class at least, and their share of the host's pages.
SUPPORT, SHARE = 8, 0.25

#: Element names of HTML by what they do here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript iframe noframes xmp title".split())
ASIDE = frozenset("head nav header footer aside form menu dialog script style textarea noscript iframe noframes xmp title template svg math canvas object audio video map select datalist button fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An opening tag of these closes an open element of the same kind, up to the element that holds the list.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in a class, id or role that name an element as no content, and words that turn them round.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside complementary footer contentinfo masthead cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login signin search share sharing social related recommended recommendations comment comments commentlist disqus "
    "reply replies respond reviews pagination pager toolbar toc hidden".split()
)
TURNS = frozenset("with has no without".split())
HEADER_WORDS = frozenset("header banner".split())
#: Words that make up the names of elements that hold the text.
CONTENT = frozenset("content main article body entry story text primary".split())

#: A comment, a declaration, or a tag with its name and attributes; a quoted value may hold ``>``.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?>[^>"'<]+|"[^"<]*"|'[^'<]*'|["'])*)(?:>|(?=<)|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
CLOSED = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Element:
    name: str
    path: int  # hash of the path, what tells tags apart
    aside: bool  # this element or one around it is no content
    inside: bool  # an article or main element is around it
    header: bool = False  # the header of an article: only headings count


@dataclass(slots=True)
class Block:
    """Text between two tags of block elements."""

    path: int
    inside: bool
    runs: list[str] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)  # token of each run; 0 for white space
    chars: int = 0  # a text that is blank counts for nothing
    linked: int = 0


def _token(path: int, text: str) -> int:
    """A token of 63 bits; 0 is none."""
    return xxhash.xxh64_intdigest(text, path) >> 1 or 1


@lru_cache(4096)
def _named(name: str, attributes: str) -> tuple[str, set[str], bool]:
    """What tells an element apart (name and class), the words of its class, id and role, and if it is the main one."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    said = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    words: set[str] = set()
    content = False
    for one in said.split():
        parts, before = [w.lower() for w in PARTS.findall(one)], ""
        content |= bool(parts) and CONTENT.issuperset(parts)
        for w in parts:
            if before not in TURNS:
                words.add(w)
            before = w
    main = name in ("article", "main") or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    if main or content:
        # A layout's name on the element of the text itself ("sidebar-right", "tag-ads") doesn't count, its own kind does.
        words &= {w.lower() for w in said.split()}
    return f"{name}.{' '.join(sorted(re.sub(r'[0-9]+', '', found.get('class', '')).split()))}", words, main


class Page:
    """Tokens and blocks of one page, read in one pass."""

    def __init__(self, html: str, tokens: bool = True) -> None:
        self.tokens = tokens  # whether texts are told apart, too
        self.counts: dict[int, int] = {}  # tag token -> count
        self.parents: dict[int, int] = {}
        self.blocks: list[Block] = []
        self.stack = [Element("", 1, False, False)]
        self.links = 0
        self.now: Block | None = None
        self._read(html)

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.aside or (top.header and top.name not in HEADINGS and not any(e.name in HEADINGS for e in self.stack)):
            return
        if (block := self.now) is None:
            block = self.now = Block(top.path, top.inside)
            self.blocks.append(block)
        block.runs.append(raw)
        if self.tokens:
            bare = raw.strip()
            chars = len(bare)
            block.tokens.append(_token(top.path, bare) if bare else 0)
        else:
            chars = 0 if raw.isspace() else len(raw)
        block.chars += chars
        if self.links:
            block.linked += chars

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            if self.now is not None:
                self.now.runs.append(" ")
                if self.tokens:
                    self.now.tokens.append(0)
            return
        if name in INLINE:
            self.links += name == "a"
            return
        self.now, self.links = None, 0
        if name in ENDS_P:
            if self.stack[-1].name == "p" or any(e.name == "p" for e in self.stack):
                self._close("p")
        elif name in SIBLINGS:
            same, around = SIBLINGS[name]
            for e in reversed(self.stack):
                if e.name in around:
                    break
                if e.name in same:
                    self._close(e.name)
                    break
        top = self.stack[-1]
        what, words, main = _named(name, attributes)
        path = _token(top.path, what)
        self.counts[path] = self.counts.get(path, 0) + 1
        self.parents[path] = top.path
        if name in VOID:
            return
        inside = top.inside or main
        header = top.header or (inside and (name == "header" or bool(words & HEADER_WORDS)) and not main)
        named = words - HEADER_WORDS if inside else words | (words & {"header"})
        aside = top.aside or (name in ASIDE and not (name == "header" and inside)) or (bool(named & WORDS or (not inside and "header" in named)) and name not in ("html", "body") and not (name == "main"))
        self.stack.append(Element(name, path, aside, inside, header))

    def _close(self, name: str) -> None:
        if name in INLINE:
            self.links = max(0, self.links - (name == "a"))
            return
        self.now, self.links = None, 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == name:
                del self.stack[k:]
                return
            if name == "p" and self.stack[k].name in ("div", "article", "section", "td", "li", "body"):
                return

    def _read(self, html: str) -> None:
        at, find = 0, TAG.search
        while (m := find(html, at)) is not None:
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if not (name := m[2]):
                continue
            name = name.lower()
            if m[1]:
                self._close(name)
                continue
            self._open(name, m[3])
            if name in RAW:
                end = CLOSED[name].search(html, at)
                at = end.end() if end else len(html)
                self._close(name)
        if at < len(html):
            self._text(html[at:])

    def text(self, template: frozenset[int] | set[int]) -> str:
        """The text of the slots: ``template`` has the host's template texts and menu paths, as tokens."""
        inside = any(b.inside and b.chars for b in self.blocks)
        out = []
        for b in self.blocks:
            if b.inside != inside or not b.chars or b.path in template:
                continue
            if not inside and 2 * b.linked > b.chars:
                continue
            runs = (r for r, t in zip(b.runs, b.tokens, strict=True) if t not in template) if template else b.runs
            out += "".join(map(unescape, runs)).split()
        return " ".join(out)


def host_of(url: str) -> F.Column:
    found = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(found, r"^www\.", "")


TOKENS = "host string, token bigint, parent bigint, tag boolean, pages bigint, low bigint, high bigint, chars bigint, linked bigint"


def tokens_of(pages: DataFrame) -> DataFrame:
    """(host, token, parent, tag, pages, low, high, chars, linked): occurrence vectors of the tokens of ``pages`` (host, key, html).

    ``low`` and ``high`` sum hashes of (page, count); ``chars`` and ``linked`` are the text right in a tag and its part in links.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, key, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(html)
                texts: dict[int, tuple[int, int]] = {}
                counts = {(t, page.parents[t], True): n for t, n in page.counts.items()}
                for b in page.blocks:
                    c, k = texts.get(b.path, (0, 0))
                    texts[b.path] = c + b.chars, k + b.linked
                    for t in b.tokens:
                        if t:
                            counts[t, b.path, False] = counts.get((t, b.path, False), 0) + 1
                for (token, parent, tag), n in counts.items():
                    vector = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), key & (1 << 64) - 1)
                    s = sums.setdefault((host, token), [parent, tag, 0, 0, 0, 0, 0])
                    c, k = texts.get(token, (0, 0)) if tag else (0, 0)
                    for i, x in enumerate((1, vector & 0xFFFFFFFF, vector >> 32, c, k), 2):
                        s[i] += x
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5]
            rows = zip(*((h, t, *v) for (h, t), v in sums.items()), strict=True)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], [x.split()[0] for x in TOKENS.split(", ")])
        trim()

    parts = pages.mapInArrow(read, TOKENS)
    total = [F.sum(c).alias(c) for c in ("pages", "low", "high", "chars", "linked")]
    return parts.groupBy("host", "token").agg(F.min("parent").alias("parent"), F.max("tag").alias("tag"), *total)


def _classes(tokens: DataFrame, hosts: DataFrame) -> DataFrame:
    """``tokens`` on enough pages of their host, for hosts with enough pages."""
    enough = hosts.where(F.col("n") >= SUPPORT)
    return tokens.join(enough, "host").where(F.col("pages") >= SHARE * F.col("n"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, class, parent, pages, tags, texts): the valid classes of each host, and the class that each nests in.

    ``pages`` (url, html). ``class`` is the first token of the class; ``parent`` is null for the outermost.
    """
    tokens, hosts = _tokens(_keyed(pages, []))
    members = _classes(tokens, hosts)
    vector = ["host", "pages", "low", "high"]
    named = members.groupBy(*vector).agg(F.min(F.when(F.col("tag"), F.col("token"))).alias("class"), F.sum(F.col("tag").cast("long")).alias("tags"), F.sum((~F.col("tag")).cast("long")).alias("texts")).where("tags > 0")
    of = members.where("tag").join(named, vector).select("host", "token", "class", "parent")
    above = of.select("host", F.col("token").alias("parent"), F.col("class").alias("outer"))
    nested = of.join(above, ["host", "parent"], "left").where("outer IS NULL OR outer <> class").groupBy("host", "class").agg(F.min("outer").alias("parent"))
    return named.join(nested, ["host", "class"], "left").select("host", "class", "parent", "pages", "tags", "texts")


def _keyed(pages: DataFrame, more: list[str]) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select(*more, host_of("url").alias("host"), html.alias("html"))


def _tokens(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens of ``SUPPORT`` pages and more, and the pages (n) of each host."""
    keys = pages.select("host", F.xxhash64("host", "html", *[c for c in pages.columns if c not in ("host", "html")]).alias("key"), "html")
    return stored(tokens_of(keys).where(F.col("pages") >= SUPPORT), "page-tokens"), pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    given = _keyed(pages, ["page_id", "url"])
    tokens, hosts = _tokens(given)
    members = _classes(tokens, hosts)
    vector = ["host", "pages", "low", "high"]
    texts = members.where("NOT tag").join(members.where("tag").select(*vector).distinct(), vector, "left_semi")
    menus = members.where("tag AND chars > 0 AND 2 * linked > chars")
    # Each token is on a quarter of the host's pages at least, so a host has at most four times the tokens of a page.
    template = stored(texts.unionByName(menus).groupBy("host").agg(F.collect_list("token").alias("template")), "page-templates")
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, template = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = [Page(h, tokens=bool(t)).text(frozenset(t or ())) for h, t in zip(html, template, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])
        trim()

    joined = given.join(template, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars bigint")
