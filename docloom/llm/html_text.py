"""HTML main text with site template removal (operator 7).

Element subtrees are hashed bottom-up (tag, class, id, text, children), counted per host in Spark, and
deleted where they recur on many pages of the host: at least ``TEMPLATE_PAGES`` pages and
``TEMPLATE_SHARE`` of the host's pages.  What holds the article itself never counts as template (page,
article and main elements, and paragraphs, headings, list items and the like within an article), so
sentences that many articles share stay; a page without such an element loses them.

From the rest, the article element (else main, else body) is read without menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments, told by tag, role and whole class and id
names.  Names that an article may give to its own parts (a notice, a reply) count outside articles only, and within them
where most of the text is links.  Of several articles beside each other the one with the h1 is read, else the longest.

Templates are sent to the tasks when at most ``BROADCAST_TEMPLATES`` of them (8 bytes each); beyond that
pages and templates are joined by a shuffle of (page, subtree) pairs and of the pages.

Defined results: null and broken html give what can be read, at least the empty string, in time linear in
their length; hosts are
compared in lower case, a null or relative url has the empty host; every input row gives one row, also
where ids are null or repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.2
BROADCAST_TEMPLATES = 1_000_000

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open p.
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot dd dt li body html".split()) | {"hr"}
#: Start tags that end an open element of the first tags, unless one of the second was opened in it.
ENDS_SELF = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Content of articles, never a template there.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption table tbody thead tfoot tr td th".split())
DROP_TAGS = frozenset("script style nav footer aside form noscript template iframe svg button select textarea head dialog menu search object embed canvas title".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Class and id words of what is no article text wherever it stands, in any element.
STRONG_NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsored comment comments disqus cookie cookies gdpr newsletter breadcrumb breadcrumbs navbar sidebar footer".split())
#: Words that an article may use for its own parts too: they count outside articles, and within them where most of the text is links.
WEAK_NAMES = frozenset("sponsor promo promotion banner consent notice notices alert menu nav navigation reply replies responses subscribe subscription social share sharing related popup modal overlay widget login signup toolbar pagination pager skip".split())
#: Words that only say where or what kind of box; a name is telling if all its words are of these lists and one is of the two above.
BOX_NAMES = frozenset("site page main post article blog entry top bottom left right header head inner outer wrapper wrap container content contents box block body section area region list items item thread link links button buttons icons bar row col column slot unit group panel form text title main primary secondary global sticky fixed js posts articles stories story more read reading latest".split())
#: Dropped outside articles only: articles have headers of their own, with their title.
DROP_OUTSIDE = frozenset("header masthead topbar".split())


def telling(tokens: frozenset[str]) -> tuple[bool, bool]:
    """Whether a whole class or id names what is no article, by a strong and by a weak word.

    "comment-list" and "site-footer" do; "share-price-table" and "related-work" have a word that is neither of a box
    nor in the lists, so they name something of the article's own.
    """
    strong = weak = False
    for token in tokens:
        words = [w for x in _NAMES.split(token) if (w := x.rstrip("0123456789"))]
        if words and all(w in STRONG_NAMES or w in WEAK_NAMES or w in BOX_NAMES for w in words):
            strong |= any(w in STRONG_NAMES for w in words)
            weak |= any(w in WEAK_NAMES for w in words)
    return strong, weak


def _tag_end(source: str, at: int, doomed: set[int]) -> int:
    """End of the start tag whose attributes begin at ``at``: behind the next > outside quotes, or behind any > if there is none.

    ``doomed`` keeps the quotes from which no such > can be reached, so that broken pages take linear time too.
    """
    met, i = [], at
    while (m := _MARK.search(source, i)) is not None and m.start() not in doomed:
        if m[0] == ">":
            return m.end()
        met.append(m.start())
        i = source.find(m[0], m.end()) + 1
        if not i:
            break
    doomed.update(met)
    return source.index(">", at) + 1


def _next_markup(source: str, at: int, last: int, doomed: set[int]) -> tuple[int, int, str | None, str] | None:
    """(start, end, name, attributes) of the next markup; no name in comments and declarations, a slash before it in end tags.

    ``last`` is the place of the page's last >, behind which only comments are markup.
    """
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            return start, end + 3 if end >= 0 else len(source), None, ""
        if start > last:
            at = source.find("<!--", start)
            if at < 0:
                return None
            continue
        if source[start + 1] in "!?":
            return start, source.index(">", start) + 1, None, ""
        m = _NAME.match(source, start + 1)
        if m is None:
            at = start + 1
        elif m[0][0] == "/":
            return start, source.index(">", m.end()) + 1, m[0].lower(), ""
        else:
            end = _tag_end(source, m.end(), doomed)
            return start, end, m[1].lower(), source[m.end() : end - 1]
    return None


class _Open:
    """Stack of open elements that knows where each tag, and any block, is open last; page first."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["#page"]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, node: int, tag: str) -> None:
        self.places[tag].append(len(self.nodes))
        if tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, *tags: str) -> int:
        """Place of the last open element with one of the tags, 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all that were opened after it; 0 closes nothing."""
        while 0 < place < len(self.nodes):
            self.nodes.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()


class Page:
    """A parsed page: elements in order of their start tags, texts in page order."""

    __slots__ = ("tags", "attributes", "parents", "content", "texts")

    def __init__(self, source: str):
        self.tags, self.attributes, self.parents = ["#page"], [""], [-1]
        self.content: list[list] = [[]]
        self.texts: list[tuple[int, int, str]] = []  # (number of block edges before it, element, text)
        opened, edges, at = _Open(), 0, 0
        last, doomed = source.rfind(">"), set()

        def text(x: int, y: int) -> None:
            if x < y:
                words = html.unescape(source[x:y])
                self.texts.append((edges, opened.nodes[-1], words))
                self.content[opened.nodes[-1]].append(words)

        while (found := _next_markup(source, at, last, doomed)) is not None:
            start, end, name, rest = found
            text(at, start)
            at = end
            if name is None:
                continue
            if name[0] == "/":
                opened.close(opened.last(name[1:]))
                edges += name[1:] in BLOCK
                continue
            if name in ENDS_P and opened.blocks and opened.tags[opened.blocks[-1]] == "p":
                opened.close(opened.blocks[-1])
            if name in ENDS_SELF:
                same, within = ENDS_SELF[name]
                place = opened.last(*same)
                if place > opened.last(*within):
                    opened.close(place)
            if name in BLOCK:
                edges += 1
            elif name == "br":
                self.texts.append((edges, opened.nodes[-1], " "))
            node = len(self.tags)
            self.tags.append(name)
            self.attributes.append(rest)
            self.parents.append(opened.nodes[-1])
            self.content[opened.nodes[-1]].append(node)
            self.content.append([])
            if name in VOID or (rest.endswith("/") and name not in BLOCK and name not in RAW):
                continue
            if name in RAW:
                m = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
                closed = m is not None and m.end() <= last
                stop = m.start() if closed else len(source)
                self.content[node].append(source[at:stop].strip())
                at = source.index(">", stop) + 1 if closed else stop
                continue
            opened.push(node, name)
        text(at, len(source))

    def named(self, node: int) -> tuple[frozenset, str, bool]:
        """Class and id tokens, role, hidden."""
        rest = self.attributes[node]
        if not rest.strip():
            return frozenset(), "", False
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
        names = frozenset(f"{found.get('class', '')} {found.get('id', '')}".lower().split())
        hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        return names, found.get("role", "").strip().lower(), hidden

    def subtree_hashes(self) -> dict[int, int]:
        """64-bit hash of each element that may be a template."""
        n = len(self.tags)
        in_article = [False] * n
        for i in range(1, n):
            in_article[i] = self.tags[i] in ("article", "main") or in_article[self.parents[i]]
        hashes, filled = [0] * n, [False] * n
        for i in range(n - 1, -1, -1):
            parts = [self.tags[i], " ".join(sorted(self.named(i)[0]))]
            some = False
            for c in self.content[i]:
                if isinstance(c, int):
                    parts.append(f"\x01{hashes[c]:x}")
                    some |= filled[c]
                elif words := " ".join(c.split()):
                    parts.append(words)
                    some = True
            filled[i] = some
            hashes[i] = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
        return {i: hashes[i] for i in range(1, n) if filled[i] and self.tags[i] in BLOCK and self.tags[i] not in ("html", "body", "article", "main") and not (in_article[i] and self.tags[i] in CONTENT)}

    def linked(self) -> list[bool]:
        """Whether more than half of an element's characters are in links."""
        n = len(self.tags)
        all_chars, link_chars = [0] * n, [0] * n
        for _, node, words in self.texts:
            all_chars[node] += len("".join(words.split()))
        for i in range(n - 1, 0, -1):
            if self.tags[i] == "a":
                link_chars[i] = all_chars[i]
            all_chars[self.parents[i]] += all_chars[i]
            link_chars[self.parents[i]] += link_chars[i]
        return [2 * k > c for k, c in zip(link_chars, all_chars, strict=True)]

    def main_article(self, articles: list[int], dropped: list[bool]) -> list[int]:
        """The longest of the articles that have an h1, or of all where none has one.

        Teasers of other articles, and comments that nothing names, are beside it.
        """
        if len(articles) < 2:
            return articles
        n = len(self.tags)
        of, chars, headed = [0] * n, dict.fromkeys(articles, 0), set()
        for i in range(1, n):
            of[i] = i if i in chars else of[self.parents[i]]
            if self.tags[i] == "h1" and of[i] and not dropped[i]:
                headed.add(of[i])
        for _, node, words in self.texts:
            if of[node] and not dropped[node]:
                chars[of[node]] += len("".join(words.split()))
        return [max(headed or articles, key=lambda i: (chars[i], -i))]

    def main_text(self, templates: set[int]) -> str:
        """Blocks of the article; ``templates`` are elements to leave out."""
        n = len(self.tags)
        dropped, inside = [False] * n, [False] * n
        roots: dict[str, list[int]] = {"article": [], "main": [], "body": []}
        linked = self.linked()
        for i in range(1, n):
            tag, parent = self.tags[i], self.parents[i]
            inside[i] = inside[parent] or tag == "article"
            drop = dropped[parent] or tag in DROP_TAGS or i in templates
            if not drop and tag not in ("html", "body", "main"):
                names, role, hidden = self.named(i)
                strong, weak = telling(names)
                own = tag in CONTENT or tag == "article"
                drop = hidden or role in DROP_ROLES or strong or (weak and not own and (not inside[i] or linked[i]))
                drop = drop or (not inside[i] and (tag == "header" or bool(names & DROP_OUTSIDE)))
            dropped[i] = drop
            if tag in roots and not drop and not (tag == "article" and inside[parent]):
                roots[tag].append(i)
        roots["article"] = self.main_article(roots["article"], dropped)
        chosen = next((roots[t] for t in ("article", "main", "body") if roots[t]), [0])
        wanted = [False] * n
        for i in chosen:
            wanted[i] = True
        for i in range(1, n):
            wanted[i] = wanted[i] or wanted[self.parents[i]]
        blocks: list[str] = []
        edge, parts = -1, []
        for e, node, words in [*self.texts, (-2, 0, "")]:
            if e != edge:
                if parts and (block := " ".join("".join(parts).split())):
                    blocks.append(block)
                edge, parts = e, []
            if e != -2 and wanted[node] and not dropped[node]:
                parts.append(words)
        return "\n".join(blocks)


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def site_key(host: str, subtree: int) -> int:
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), seed=subtree & ((1 << 64) - 1)) - (1 << 63)


def subtree_keys(pages: DataFrame) -> DataFrame:
    """(row, host, key) for each distinct subtree of pages(row, url, html); key names host and subtree.

    One row more per page, with a null key, counts the page itself.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hosts, keys = [], [], []
            for row, url, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                host = _host(url)
                found = {site_key(host, h) for h in Page(source or "").subtree_hashes().values()}
                rows += [row] * (len(found) + 1)
                hosts += [host] * (len(found) + 1)
                keys += [None, *found]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hosts, pa.string()), pa.array(keys, pa.int64())], ["row", "host", "key"])

    return pages.mapInArrow(emit, "row long, host string, key long")


def site_templates(keys: DataFrame, min_pages: int, share: float) -> DataFrame:
    """(key) of the subtrees that recur on many pages of their host."""
    counts = keys.groupBy("host", "key").count()
    sizes = counts.filter("key IS NULL").select("host", F.col("count").alias("pages"))
    often = counts.filter(F.col("key").isNotNull() & (F.col("count") >= min_pages))
    return often.join(sizes, "host").filter(F.col("count") >= F.col("pages") * share).select("key")


def _extract(pages: DataFrame, id_type: str, templates) -> DataFrame:
    """Texts of pages(id, url, html[, found]); templates: broadcast keys, or None where ``found`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates.value if templates is not None else None
        for batch in batches:
            texts = []
            own = batch.column(3).to_pylist() if known is None else [None] * batch.num_rows
            for url, source, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), own, strict=True):
                page, gone = Page(source or ""), set()
                if known is None or len(known):
                    host = _host(url)
                    keys = {i: site_key(host, h) for i, h in page.subtree_hashes().items()}
                    if known is None:
                        listed = set(mine or ())
                        gone = {i for i, k in keys.items() if k in listed}
                    elif keys:
                        k = np.array(list(keys.values()), dtype=np.int64)
                        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                        gone = {i for i, hit in zip(keys, known[at] == k, strict=True) if hit}
                texts.append(page.main_text(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def main_texts(pages: DataFrame, min_pages: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE, broadcast_limit: int = BROADCAST_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "url", "html", F.col("page_id").alias("id"))
    keys = materialise(subtree_keys(rows.select("row", "url", "html")), "page-subtrees")
    templates = materialise(site_templates(keys, min_pages, share), "page-templates")
    id_type = pages.schema["page_id"].dataType.simpleString()
    if templates.limit(broadcast_limit + 1).count() <= broadcast_limit:
        known = np.sort(np.array([r.key for r in templates.collect()], dtype=np.int64))
        return _extract(rows.select("id", "url", "html"), id_type, pages.sparkSession.sparkContext.broadcast(known))
    found = keys.join(templates, "key").groupBy("row").agg(F.collect_set("key").alias("found"))
    return _extract(rows.join(found, "row", "left").select("id", "url", "html", "found"), id_type, None)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
