"""Main text of web pages: site templates are found by hashing element subtrees and counting them per host.

Every page is parsed into its block elements, inside its article and outside. Each gets a hash of all that it holds (tag
names and text) and, if most of its text is links, one of its shape (tags and names, runs of like children taken
together), as menus keep their shape where their words change. Spark counts the pages of each host that hold a hash.

A subtree is deleted if its hash or shape is on `LEAST_PAGES` pages of its host, more than hold the page's article as it
is, so that an article which a host repeats stays whole; a bare paragraph of an article, which quotes and refrains
share, must be on `LEAST_SHARE` of the host's pages as well. Marks of HTML are evidence beside the counts: for an element whose
tag, role or name says menu, header, footer, sidebar, notice, advert, form or comments one page is enough. Marks don't
count on what holds more than half of the text of a page that has no article outside of them. If elements marked as
article hold at least half of what is left, the text is theirs, else all that is left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import BROADCAST_ROWS, documents, kept

#: A subtree is template from so many pages of its host on; a bare paragraph in an article needs that share of them too.
LEAST_PAGES, LEAST_SHARE = 5, 0.3
#: The share of links in the text from which a shape is counted.
LINKS = 0.5

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
MARKED = frozenset("nav footer aside form button dialog menu fieldset header".split())
BARE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd td th tr table blockquote pre figure figcaption".split())
CLOSES = {  # an opening tag ends these open ones
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

#: Words of class and id names that mark an element, and words beside them that take the mark back.
NAMES = frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar sidebars widget widgets ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion "
    "banner banners cookie cookies consent notice notices popup popups modal overlay newsletter subscribe subscription comment comments replies disqus respond share sharing social breadcrumb "
    "breadcrumbs related recommended pagination pager hidden".split()
)
UNMARKED = frozenset("no not non has with without on in about of the".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WHITE = re.compile(r"\s+")
JOINT = re.compile(r"[-_]+")


def attributes(raw: str) -> dict[str, str]:
    """The attributes of a tag by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return out


def marked(tag: str, own: dict[str, str], in_article: bool) -> bool:
    """Whether the tag, role or names of an element say that it is no part of the article."""
    if tag in MARKED and not (tag == "header" and in_article):
        return True
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role") in ROLES:
        return True
    if tag in ("html", "body"):
        return False
    names = [set(JOINT.split(name)) for key in ("class", "id") for name in own.get(key, "").split()]
    return any(n & NAMES and not n & UNMARKED and not (tag == "header" and in_article) for n in names)


def _hash(value: str, seed: int) -> int:
    return xxh64_intdigest(value.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


class Element:
    """A block element: its parent, what marks it, and what its subtree holds."""

    __slots__ = ("article", "bare", "content", "held", "kinds", "links", "mark", "name", "parent", "shape", "size", "tag")

    def __init__(self, tag: str, parent: int, own: dict[str, str], in_article: bool):
        self.tag, self.parent, self.mark = tag, parent, marked(tag, own, in_article)
        self.article = tag in ("article", "main")
        self.bare = tag in BARE and not own.get("class") and not own.get("id")
        self.name = " ".join((tag, own.get("class", ""), own.get("role", "")))
        self.held: list[str] = [tag]
        self.kinds: list[str] = [self.name]
        self.size = self.links = self.content = self.shape = 0


class Page:
    """A page's blocks in order, (text, its element), and its block elements, parents first; -1 is the page."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int]] = []
        self.elements: list[Element] = []
        self._stack: list[tuple[str, int]] = []  # tag and element
        self._text: list[tuple[str, bool]] = []  # raw text and whether it is a link's
        self._link = False
        at = 0
        for m in iter(lambda: TOKEN.search(html, at), None):
            if m.start() > at:
                self._text.append((html[at : m.start()], self._link))
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in RAW or tag in ("head", "title"):  # what stands in these is no text
                self._break()
                if tag != "head" and not (m[3] or "").endswith("/"):
                    at = re.compile(rf"</{re.escape(tag)}\s*>|$", re.IGNORECASE).search(html, at).end()
            else:
                self._open(tag, m[3] or "")
        self._text.append((html[at:], self._link))
        self._break()
        while self._stack:
            self._pop()

    def _break(self) -> None:
        """Ends a block: its white space becomes single spaces."""
        if self._text:
            text = WHITE.sub(" ", unescape("".join(t for t, _ in self._text))).strip()
            links = sum(len(t.strip()) for t, link in self._text if link)
            self._text.clear()
            if text:
                at = self._stack[-1][1] if self._stack else -1
                self.blocks.append((text, at))
                if at >= 0:
                    element = self.elements[at]
                    element.held.append(text)
                    element.size += len(text)
                    element.links += min(links, len(text))

    def _open(self, tag: str, raw: str) -> None:
        if tag in INLINE:
            self._link = self._link or tag == "a"
            return
        self._break()
        if tag in VOID:
            return
        if tag in ENDS_P:
            for k in range(len(self._stack) - 1, max(len(self._stack) - 4, -1), -1):
                if self._stack[k][0] == "p":
                    while len(self._stack) > k:
                        self._pop()
                    break
        while self._stack and self._stack[-1][0] in CLOSES.get(tag, ()):
            self._pop()
        at = self._stack[-1][1] if self._stack else -1
        if tag not in ("html", "body"):
            inside = any(self.elements[k].article for _, k in self._stack if k >= 0)
            self.elements.append(Element(tag, at, attributes(raw) if raw.strip() else {}, inside))
            at = len(self.elements) - 1
        self._stack.append((tag, at))

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            self._link = self._link and tag != "a"
            return
        self._break()
        if tag in VOID:
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                while len(self._stack) > k:
                    self._pop()
                return
            if self._stack[k][0] in ("article", "main", "body") and tag not in ("html", "body"):
                return

    def _pop(self) -> None:
        tag, at = self._stack.pop()
        if tag in ("html", "body"):
            return
        own = self.elements[at]
        own.content = _hash("\0".join(own.held), 7)
        own.shape = _hash("\0".join(own.kinds), 11)
        if own.parent >= 0:
            above, kind = self.elements[own.parent], str(own.shape)
            above.held.append(str(own.content))
            if above.kinds[-1] != kind:
                above.kinds.append(kind)
            above.size += own.size
            above.links += own.links

    def _linked(self, own: Element) -> bool:
        return own.links >= LINKS * own.size > 0

    def hashes(self) -> set[int]:
        """What is counted once for the page: the contents of its elements, and the shapes of those that are mostly links."""
        full = [e for e in self.elements if e.size]
        return {e.content for e in full} | {e.shape for e in full if self._linked(e)}

    def _out(self, seen: Mapping[int, int], pages: int, least_pages: int, least_share: float) -> list[bool]:
        """Which elements are deleted, given on how many pages of the host each hash is."""
        elements = self.elements
        below: list[bool] = []  # under a mark
        inside: list[int] = []  # the outermost article around, or -1
        for k, own in enumerate(elements):
            below.append(own.mark or (own.parent >= 0 and below[own.parent]))
            inside.append(inside[own.parent] if own.parent >= 0 and inside[own.parent] >= 0 else k if own.article else -1)
        has_article = any(own.article and own.size and not under for own, under in zip(elements, below, strict=True))
        total = sum(len(text) for text, _ in self.blocks)
        out: list[bool] = []
        for k, own in enumerate(elements):
            article = elements[inside[k]] if inside[k] >= 0 else None
            copies = seen.get(article.content, 0) if article else 0
            n = seen.get(own.content, 0) - copies
            recurs = n >= least_pages and not (own.bare and article and n < least_share * pages)
            menu = self._linked(own) and seen.get(own.shape, 0) >= least_pages and own is not article and not (own.bare and article)
            mark = own.mark and (has_article or 2 * own.size <= total)
            out.append(recurs or menu or mark or (own.parent >= 0 and out[own.parent]))
        return out

    def text(self, seen: Mapping[int, int] | None = None, pages: int = 0, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> str:
        """The blocks that are left, or those of them in articles, joined by spaces; `seen`: pages of the host by hash."""
        out = self._out(seen or {}, pages, least_pages, least_share)
        left = [(text, k) for text, k in self.blocks if k < 0 or not out[k]]
        article: list[bool] = []
        for own in self.elements:
            article.append(own.article or (own.parent >= 0 and article[own.parent]))
        chosen = [text for text, k in left if k >= 0 and article[k]]
        if 2 * sum(map(len, chosen)) >= sum(len(text) for text, _ in left):
            return " ".join(chosen)
        return " ".join(text for text, _ in left)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host); a url without a host shares the host ''."""
    return pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, hash, n): the hashes of (host, html) on at least so many pages of their host; under 0 each host's pages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()  # summed before the shuffle
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                found.update((host, h) for h in {*Page(html.as_py() or "").hashes(), 0})
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([found[k] for k in keys], pa.int64())], ["host", "hash", "n"])

    counts = pages.select("host", "html").mapInArrow(work, "host string, hash long, n long").groupBy("host", "hash").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= least_pages) | (F.col("hash") == 0))


def _held(pages: DataFrame, found: DataFrame) -> DataFrame:
    """`pages` with `seen`, their own hashes that are in `found`: joined hash by hash, so that no page gets all of its host's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host, key, h) for host, key, html in zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), batch.column("html"), strict=True) for h in {*Page(html.as_py() or "").hashes(), 0}]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "key", "hash"])

    keyed = pages.withColumn("key", F.xxhash64("host", "html"))
    own = keyed.select("host", "key", "html").mapInArrow(work, "host string, key long, hash long").distinct().join(found, ["host", "hash"])
    seen = kept(own.groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("hash", "n")).alias("seen")))
    return keyed.join(seen, F.col("key") == F.col("of"), "left").drop("key", "of")


def extracted(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text) of every row of `pages` (page_id, url, html); other columns are left.

    Null and empty html give an empty text; rows that repeat a page_id are pages of their own; an empty table gives no
    rows. The recurring hashes are broadcast if they are at most `broadcast_rows`; else each page is joined with its own.
    """
    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string"
    pages = with_host(pages)
    found = kept(templates(pages, least_pages))
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        by_host: dict[str, dict[int, int]] = {}
        for r in found.toLocalIterator():
            by_host.setdefault(r.host, {})[r.hash] = r.n
        shared, joined = pages.sparkSession.sparkContext.broadcast(by_host), pages
    else:
        shared, joined = None, _held(pages, found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared:
                sets = [shared.value.get(h, {}) for h in batch.column("host").to_pylist()]
            else:
                sets = [{x["hash"]: x["n"] for x in held or ()} for held in batch.column("seen").to_pylist()]
            out = [Page(h.as_py() or "").text(seen, seen.get(0, 0), least_pages, least_share) for h, seen in zip(batch.column("html"), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(work, kinds)


def op10_html(spark, sf_dir: str) -> DataFrame:
    return extracted(documents(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
