"""Main text of web pages by template deduction: token classes with one occurrence vector over the pages of a host."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, short_batches

# HTML's elements without content, its block elements, and elements and names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template svg math head title button select textarea iframe object canvas audio video".split())
ASIDE = frozenset("nav aside footer form dialog menu".split())
# of names in class and id: readers' comments and adverts, other furniture, and what tells that a name means content
FOREIGN = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr".split())
FURNITURE = frozenset(
    "banner sidebar menu nav navbar navigation breadcrumb breadcrumbs notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations footer header masthead topbar toolbar widget widgets search pagination pager copyright legal disclaimer skip".split()
)
CONTENT = frozenset("article story content main post entry body text has with layout page wrapper container".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_MAIN = frozenset(("article", "main"))
_CLOSES_P = BLOCK - frozenset(("html", "head", "body", "option"))
_NAME = re.compile(r"[A-Za-z]+")
_OPEN = re.compile(r"<(?:[A-Za-z!?]|/[A-Za-z])")  # of a tag or a comment that the page does not end


def _hash(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class PageReader(HTMLParser):
    """Reads one page into tags by path and text blocks; unclosed and stray tags are taken as browsers do, roughly.

    blocks: (text, path hash of its element, ring, inside article or main?, link characters). A ring is the place in rings
    of the innermost furniture around it, 0 for none; rings: (ring outside, path hash), outer ones first.
    tags: path hashes of opened elements, in order. foreign: path hashes of comments and adverts. hints off: only what can
    hold no text of a page (HIDDEN) is told by its tag, and all else is left to the template. Broken declarations are comments
    up to the next `>`, open tags and comments at the end of the page are none of its text.
    """

    def __init__(self, hints: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.hints = hints
        self.blocks: list[tuple[str, int, int, bool, int]] = []
        self.rings: list[tuple[int, int]] = [(0, 0)]
        self.tags: list[int] = []
        self.foreign: set[int] = set()
        # tag, path hash, ring, inside main, hidden
        self.stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
        self.opened: Counter[str] = Counter()  # elements on the stack by tag
        self.parts: list[str] = []
        self.links = self.anchors = 0

    def read(self, html: str) -> PageReader:
        self.feed(html)
        if _OPEN.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self._flush()
        return self

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # a keyword that no standard has
            return self.parse_bogus_comment(i)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        _, path, ring, main, hidden = self.stack[-1]
        if text and not hidden:
            self.blocks.append((text, path, ring, main, min(self.links, len(text))))
        self.parts, self.links, self.anchors = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" or tag == "wbr":
            self.parts.append(" ")
            return
        if tag == "a":
            self.anchors = 1
        if tag in BLOCK or tag in HIDDEN:
            self._flush()
            if tag in _CLOSES_P:
                self._end("p", ("article", "main", "section", "div", "td", "th", "li", "blockquote", "body", "aside"))
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                self._end(tag, ("ul", "ol", "dl", "table", "select"))
        if tag in VOID or tag not in BLOCK and tag not in HIDDEN:
            return
        _, path, ring, main, hidden = self.stack[-1]
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "itemprop", "hidden", "aria-hidden")}
        words = {w.lower() for w in _NAME.findall(f"{named.get('class', '')} {named.get('id', '')}")}
        path = _hash(str(path), tag, *sorted(words))
        main = main or tag in _MAIN or named.get("role") in ("main", "article") or named.get("itemprop") == "articleBody"
        if self.hints and tag not in ("html", "body"):
            if words & FOREIGN:
                self.foreign.add(path)
            odd = bool(words & FOREIGN) or bool(words & FURNITURE) and not words & CONTENT and not (main and words & FURNITURE <= {"header"})
            if odd or tag in ASIDE or tag == "header" and not main or named.get("role") in ROLES:
                self.rings.append((ring, path))
                ring = len(self.rings) - 1
        hidden = hidden or tag in HIDDEN or "hidden" in named or named.get("aria-hidden") == "true"
        self.tags.append(path)
        self.stack.append((tag, path, ring, main, hidden))
        self.opened[tag] += 1

    def _end(self, tag: str, bounds: tuple[str, ...] = ()) -> None:
        for k in range(len(self.stack) - 1, 0, -1) if self.opened[tag] else ():
            if self.stack[k][0] == tag:
                self._flush()
                self.opened.subtract(x[0] for x in self.stack[k:])
                del self.stack[k:]
                return
            if self.stack[k][0] in bounds:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.anchors = 0
        if tag in BLOCK or tag in HIDDEN:
            self._flush()
            self._end(tag)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.anchors:
            self.links += len(data.strip())


TAG, TEXT, AROUND, LINKED = range(4)


def page_tokens(html: str | None, hints: bool = True) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Fingerprint of the page's text, and its tokens (token, kind, number, place).

    TAG: path of an element, times, first place. TEXT: path and text of a block, times, 0. AROUND: path of furniture (0: the
    page), characters inside, characters of links. LINKED: path of blocks with links outside article and main, the same.
    """
    page = PageReader(hints).read(html or "")
    tags, texts = Counter(page.tags), Counter(_hash(str(b[1]), b[0]) for b in page.blocks)
    first = {t: k for k, t in reversed(list(enumerate(page.tags)))}
    around: dict[tuple[int, int], list[int]] = {}

    def add(key: tuple[int, int], chars: int, links: int) -> None:
        held = around.setdefault(key, [0, 0])
        held[0] += chars
        held[1] += links

    inside = [[0, 0, 0] for _ in page.rings]  # blocks, characters, characters of links
    for text, path, ring, main, links in page.blocks:
        inside[ring] = [x + y for x, y in zip(inside[ring], (1, len(text), links), strict=True)]
        if links and not main:
            add((path, LINKED), len(text), links)
    for ring in range(len(page.rings) - 1, -1, -1):  # what is in a ring is in the one outside it
        outside, path = page.rings[ring]
        if inside[ring][0] and (not ring or path not in page.foreign):
            add((path, AROUND), *inside[ring][1:])
        if ring:
            inside[outside] = [x + y for x, y in zip(inside[outside], inside[ring], strict=True)]
    out = [(t, TAG, n, first[t]) for t, n in tags.items()] + [(t, TEXT, n, 0) for t, n in texts.items()]
    return _hash(*[b[0] for b in page.blocks]), out + [(t, kind, n, links) for (t, kind), (n, links) in around.items()]


def deduce_templates(pages: DataFrame, host_col: str, html_col: str, min_pages: int, min_share: float, min_tokens: int, hints: bool = True) -> DataFrame:
    """host, template (hashes of the texts of the host's template), open (furniture that holds most text), menus (slots of links).

    Tokens (tags by path, text blocks by path) of one host fall into classes with the same occurrence vector over its
    pages. A vector is held as the exclusive or of hashes of (page, count), so that it is summed wherever rows lie and
    a hot host needs no task of its own; pages with the same texts count once. A class is valid if it is large (min_tokens
    tokens), frequent (min_share of the host's pages and min_pages at least) and ordered: first and last places of its
    tags rise together. Valid classes nest in the class of the tags that stand on every page; a text in a nested class is
    part of the template, and what stands between is a slot. Elements that a tag or a name calls furniture are none if half of the host's text is
    in them and not in links; a slot outside article and main whose text is links on most pages is a menu. A host with fewer than min_pages
    different pages has no template texts and no menus. A host's lists are bounded by the length of its pages, not by their number.
    """
    short_batches(pages.sparkSession, 128)

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, html in zip(batch["host"], batch["html"], strict=True):
                page, own = page_tokens(html, hints)
                rows += [(host, page, *x) for x in own]
            yield pd.DataFrame(rows, columns=["host", "page", "token", "kind", "n", "place"])

    rows = pages.select(F.col(host_col).alias("host"), F.col(html_col).alias("html")).mapInPandas(tokens, "host string, page long, token long, kind int, n long, place long")
    rows = rows.groupBy("host", "page", "token", "kind").agg(F.max("n").alias("n"), F.min("place").alias("place"))
    vectors = rows.groupBy("host", "token", "kind").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.min("place").alias("least"), F.max("place").alias("most"), F.sum("n").alias("chars"), F.sum("place").alias("links")
    )
    # a token of a single page is in no frequent class
    vectors = cut(vectors.filter((F.col("pages") >= min_pages) | (F.col("kind") == AROUND)))
    whole = vectors.filter((F.col("token") == 0) & (F.col("kind") == AROUND)).select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    known = vectors.join(whole, "host")
    wide = known.filter((F.col("kind") == AROUND) & (F.col("token") != 0) & (2 * F.col("chars") >= F.col("all_chars")) & (2 * F.col("links") <= F.col("chars")))
    common = known.filter((F.col("pages") >= min_pages) & (F.col("pages") >= F.col("all_pages") * min_share))
    menus = common.filter((F.col("kind") == LINKED) & (10 * F.col("links") >= 9 * F.col("chars")))
    tags = F.array_sort(F.collect_list(F.when(F.col("kind") == TAG, F.struct("least", "most"))))
    classes = common.filter(F.col("kind") <= TEXT).groupBy("host", "vector", "pages").agg(F.count(F.lit(1)).alias("size"), tags.alias("tags"), F.collect_list(F.when(F.col("kind") == TEXT, F.col("token"))).alias("texts"))
    lasts = F.transform("tags", lambda t: t["most"])
    valid = classes.filter((F.size("texts") > 0) & (F.col("size") >= min_tokens) & (lasts == F.array_sort(lasts)))
    lists = valid.select("host", F.lit(0).alias("list"), F.explode("texts").alias("token")).unionByName(wide.select("host", F.lit(1).alias("list"), "token")).unionByName(menus.select("host", F.lit(2).alias("list"), "token"))
    pick = [F.collect_list(F.when(F.col("list") == k, F.col("token"))).alias(name) for k, name in enumerate(("template", "open", "menus"))]
    return lists.groupBy("host").agg(*pick)


def packed_page(html: str | None, hints: bool = True) -> bytes:
    """The page's text blocks, packed: what is left of it to travel to its host's template."""
    page = PageReader(hints).read(html or "")
    names = {p: k for k, p in enumerate(dict.fromkeys([*(path for _, path in page.rings[1:]), *(b[1] for b in page.blocks)]))}
    rings = [(outside, names[path]) for outside, path in page.rings[1:]]
    rows = [(text, names[path], ring, main) for text, path, ring, main, _ in page.blocks]
    return zstandard.compress(json.dumps([list(names), [names[x] for x in page.foreign if x in names], rings, rows], ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))


def main_text(packed: bytes, template: frozenset[int] = frozenset(), wide: frozenset[int] = frozenset(), menus: frozenset[int] = frozenset()) -> str:
    """The page's slots, in page order, joined by newlines, without those in furniture or menus.

    Furniture in `wide` counts as none, but for comments and adverts.
    """
    names, foreign, rings, rows = json.loads(zstandard.decompress(packed).decode("utf-8", "surrogatepass"))
    closed, foreign, out = [False], set(foreign), []
    for outside, x in rings:
        closed.append(closed[outside] or names[x] not in wide or x in foreign)
    for text, path, ring, main in rows:
        if closed[ring]:
            continue
        if names[path] in menus and not main or template and _hash(str(names[path]), text) in template:
            continue
        out.append(text)
    return "\n".join(out)


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 4, min_share: float = 0.6, min_tokens: int = 3, hints: bool = True, salt: int = 16) -> DataFrame:
    """pages with a column text: the main text of the whole html, "" if there is none.

    Null html counts as empty; a null or odd url puts the page among those of the host "". The text is that of the slots
    of the host's template (deduce_templates), without menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and comments, as tags and names tell them (hints); blocks come in page order, white space inside a block becomes
    one blank. A column named text is replaced, all others stay. Repeated rows count once for the template; no rows give
    no rows. Pages travel to the templates as packed text; a host's pages are dealt over `salt` places, each with a copy of its template.
    """
    short_batches(pages.sparkSession, 128)
    host = F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    known = cut(deduce_templates(pages.select(host.alias("_host"), html_col), "_host", html_col, min_pages, min_share, min_tokens, hints))

    @F.pandas_udf("binary")
    def pack(htmls: pd.Series) -> pd.Series:
        return pd.Series([packed_page(h, hints) for h in htmls], dtype=object)

    @F.pandas_udf("string")
    def extract(packed: pd.Series, template: pd.Series, wide: pd.Series, menus: pd.Series) -> pd.Series:
        lists = [[frozenset(() if x is None else map(int, x)) for x in own] for own in (template, wide, menus)]
        return pd.Series([main_text(*x) for x in zip(packed, *lists, strict=True)], dtype=object)

    free = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in pages.columns))  # no column of pages begins like this
    mine = {name: f"{free}{name}" for name in ("packed", "host", "salt", "template", "open", "menus")}
    others = [F.col(f"`{c}`") for c in pages.columns if c != "text"]
    rows = pages.select(*others, pack(F.col(html_col)).alias(mine["packed"]), host.alias(mine["host"]))
    rows = rows.withColumn(mine["salt"], F.pmod(F.xxhash64(mine["packed"]), F.lit(salt)).cast("int"))
    dealt = known.select(*[F.col(c).alias(mine[c]) for c in ("host", "template", "open", "menus")], F.explode(F.array([F.lit(k) for k in range(salt)])).alias(mine["salt"]))
    return rows.join(dealt, [mine["host"], mine["salt"]], "left").select(*others, extract(*[mine[c] for c in ("packed", "template", "open", "menus")]).alias("text"))
