"""Main text of HTML pages by tree scoring.

A page's tags are read once into a tree with the implied ends of HTML. Elements and roles that are never part of an
article (menus, footers, scripts, styles and so on) are cut. Every paragraph passes points for its length and commas to its
parent, half of them to the next ancestor and so on; a container's points are discounted by its share of link
text. The best container is kept, widened to the article element around it if there is one, with
those siblings that score well or read like text.

Names (classes and ids such as sidebar, cookie-notice, comments) and forms are signs only: such a part is cut if the rest of
the page has text of its own. Where the rest is worth less than ``REST_SHARE`` of it, it is a wrapper around the article, as
layouts name them, and stays; what reads as comments or adverts stays only if nothing else is there.

Character references are decoded once; white space in a block becomes one space; blocks are joined
in page order by one space. Nothing is capped.

Defined results: a null or empty page has the empty text, like one without any text; unclosed or
stray tags are read as browsers do, roughly; repeated rows give the same text; a null id or url is passed on; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import as_text, table

# Names of elements, roles and parts of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CUT_ELEMENTS = frozenset("head nav footer aside button select dialog menu search canvas object audio video fieldset label".split()) | RAW
#: Elements that an article may use for text of its own.
OWN_ELEMENTS = frozenset("fieldset label".split())
#: Words that go with a part's name: inside an article a name cuts only if all its words are names of parts or such words (related-posts, but not share-price).
BESIDE = frozenset("a all and area article articles bar block body bottom box button buttons by card cards container content count for group head icon icons inner item items left link links list lists main more new on outer page panel post posts right row section side site stories story text the title to top user wrap wrapper".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
CUT_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs byline
    comment comments commentlist consent cookie cookies discussion disqus disclaimer footer form header login masthead menu
    modal nav navbar navigation navigator newsletter notice notices notification overlay pager pagination paywall
    popup promo promotion promoted recommended recommendations related replies reply respond share sharing shares
    sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar
    widget widgets alert aside rail teaser trending gdpr responses response search searchbox feedback""".split()
)
#: A name with one of these tells a state of the page and names no part: no-sidebar, comments-open.
STATES = frozenset("no has with without is not non open opened closed enabled disabled on off free none hidden count".split())
#: Share of a named part's points below which the rest of the page is no article: the part stays.
REST_SHARE = 0.25
#: Elements that a name cuts only if it is one of readers' comments or adverts.
FIRM = frozenset("html body main article".split())
FIRM_CUTS = frozenset("ad ads advert advertisement comment comments commentlist reply replies sponsored promo related teaser".split())
#: A name that marks an article's own head, beside one of an article's parts, cuts nothing; nor does it cut a heading.
HEAD_NAMES, OWN_NAMES = frozenset("header byline".split()), frozenset("article content entry post story page".split())
#: An element of the first kind ends an open one of the second, up to an element of the third.
IMPLIED = {
    **{k: (frozenset(["p"]), frozenset("article aside blockquote body button caption dd details dialog div dt fieldset figcaption figure footer form header html li main nav section table td th".split())) for k in BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}},
    "li": (frozenset(["li", "p"]), frozenset("ol ul menu dir".split())),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p"]), frozenset(["table"])),
}
#: Points of a paragraph: one, one a comma, one each so many characters up to the most.
LENGTH_STEP, LENGTH_MOST = 100, 3
#: Link share above which a list or box inside the article is cut, and below which a sibling reads like text.
LINKS_CUT, LINKS_TEXT = 0.5, 0.25
SIBLING_SHARE = 0.2
#: Share of the best article's text that another article of the page has at least, if it is to be joined.
ARTICLE_SHARE = 0.5
#: How sure a cut is: not cut, by a name or form, by a name of comments or adverts, by the element itself.
STAYS, NAMED, FIRMLY, SURE = range(4)

_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|/[^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _cut(tag: str, attributes: str, within: bool = False) -> int:
    """How sure it is that an element is no part of an article, by its own tag and attributes; ``within`` an article element names have to be plainer."""
    if tag in CUT_ELEMENTS and not (within and tag in OWN_ELEMENTS):
        return SURE
    sign = NAMED if tag == "form" else STAYS
    if not attributes or attributes.isspace():
        return sign
    firm = tag in FIRM
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(a or b or c)
        if name == "role" and not firm and value.strip().lower() in CUT_ROLES:
            return SURE
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            if not firm or tag == "article":
                return SURE
        if name in ("class", "id") and tag not in ("html", "body"):
            for token in value.split():
                parts = {x.lower() for x in _NAME.findall(token)}
                cuts = parts & (FIRM_CUTS if firm or tag in HEADINGS else CUT_NAMES)
                if within and not all(x in CUT_NAMES or x in BESIDE or x.isdigit() for x in parts):
                    continue
                if cuts and not parts & STATES and not (cuts <= HEAD_NAMES and (tag == "header" or parts & OWN_NAMES)):
                    sign = max(sign, FIRMLY if cuts & FIRM_CUTS else NAMED)
    return sign


class Tree:
    """A page: nodes numbered in page order, and the stretches of text with the node each is in."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.end = ["#root"], [0], [0]
        self.cut, self.sign, self.link, self.block = [False], [STAYS], [False], [0]
        self.within, self.open = [False], Counter()
        self.texts: list[tuple[int, str]] = []
        self._read(html)

    def _open(self, stack: list[int], tag: str, attributes: str) -> int:
        up = stack[-1]
        header = tag == "header" and not any(self.tag[k] in ("article", "main", "section") for k in stack)
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.end.append(node + 1)
        sign = SURE if header else _cut(tag, attributes, self.within[up])
        self.within.append(self.within[up] or tag == "article")
        self.open[tag] += 1
        self.cut.append(self.cut[up] or sign == SURE)
        self.sign.append(sign)
        self.link.append(self.link[up] or tag == "a")
        self.block.append(node if tag in BLOCKS else self.block[up])
        return node

    def _close(self, stack: list[int], depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        for node in stack[depth:]:
            self.end[node] = len(self.tag)
            self.open[self.tag[node]] -= 1
            if self.tag[node] in BLOCKS:
                self.texts.append((self.parent[node], " "))
        del stack[depth:]

    def _read(self, html: str) -> None:
        stack, at, lower = [0], 0, None
        while m := _TAG.search(html, at):
            if m.start() > at:
                self._text(stack[-1], html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._end_tag(stack, tag)
                continue
            attributes = m[3] or m[6] or ""
            if tag in RAW:
                lower = html.lower() if lower is None else lower
                stop = lower.find("</" + tag, at) if len(lower) == len(html) else -1
                if stop < 0:
                    found = re.compile("</" + tag, re.I).search(html, at)
                    stop = found.start() if found else len(html)
                if not attributes.endswith("/") or tag not in ("svg", "math"):
                    at = stop
                continue
            if tag == "br":
                self.texts.append((stack[-1], " "))
            if implied := IMPLIED.get(tag):
                for depth in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[depth]]
                    if name in implied[1]:
                        break
                    if name in implied[0]:
                        self._close(stack, depth)
                        if tag not in ("tr", "tbody", "tfoot", "thead", "td", "th"):
                            break
            if tag in ("html", "body") and any(self.tag[k] == tag for k in stack):
                continue
            if tag == "body":
                for depth, k in enumerate(stack):
                    if self.tag[k] == "head":
                        self._close(stack, depth)
                        break
            if tag in VOID:
                if tag in BLOCKS:
                    self.texts.append((stack[-1], " "))
                continue
            if tag in BLOCKS:
                self.texts.append((stack[-1], " "))
            stack.append(self._open(stack, tag, attributes))
        if at < len(html):
            self._text(stack[-1], html[at:])
        self._close(stack, 1)
        self.end[0] = len(self.tag)

    def _text(self, node: int, text: str) -> None:
        if not self.cut[node]:
            self.texts.append((node, unescape(text) if "&" in text else text))

    def _end_tag(self, stack: list[int], tag: str) -> None:
        if self.open[tag] <= 0:  # a stray one, whatever is open
            return
        inline = tag not in BLOCKS
        for depth in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[depth]]
            if name == tag:
                self._close(stack, depth)
                return
            if inline and name in BLOCKS or name in ("table", "td", "th") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
                return

    def article(self) -> str:
        """The main text."""
        n = len(self.tag)
        size, links, commas = [0] * n, [0] * n, [0] * n
        for node, text in self.texts:
            if length := len(text.strip()):
                block = self.block[node]
                size[block] += length
                commas[block] += text.count(",") + text.count("，") + text.count("、")
                if self.link[node]:
                    links[block] += length
        worth = [(1 + commas[k] + min(size[k] // LENGTH_STEP, LENGTH_MOST)) * (1 - links[k] / size[k]) * min(1.0, size[k] / 25) if size[k] else 0.0 for k in range(n)]
        self._cut_named(worth)
        for k in range(n):
            if self.cut[k]:
                size[k] = links[k] = worth[k] = 0
        points = [0.0] * n
        for k in range(n - 1, 0, -1):
            points[self.parent[k]] += worth[k] + points[k] / 2
        total, linked = size[:], links[:]
        for k in range(n - 1, 0, -1):
            total[self.parent[k]] += total[k]
            linked[self.parent[k]] += linked[k]
        if not total[0]:
            return ""
        density = [linked[k] / total[k] if total[k] else 0.0 for k in range(n)]
        score = [points[k] * (1 - density[k]) for k in range(n)]
        best = max((k for k in range(n) if not self.cut[k]), key=lambda k: (score[k], total[k], -k))
        up = best
        while up and self.tag[up] != "article":
            up = self.parent[up]
        if not up:
            up = best
            while up and self.tag[up] != "main":
                up = self.parent[up]
        top = up or best
        chosen = [(top, self.end[top])] if top else [(0, n)]
        if top and self.tag[top] not in ("article", "main", "body", "html"):
            chosen = [(k, self.end[k]) for k in self._siblings(top, n) if k == top or self._joins(k, score, total, density, max(1.0, SIBLING_SHARE * score[top]))]
        if top and self.tag[top] == "article":  # further articles of the page that are no teasers
            outer = [k for k in range(1, n) if self.tag[k] == "article" and not self.within[self.parent[k]] and not self.cut[k]]
            chosen += [(k, self.end[k]) for k in outer if not k <= top < self.end[k] and total[k] >= ARTICLE_SHARE * total[top] and density[k] < LINKS_TEXT]
        drop = []
        for a, b in chosen:
            if self.tag[a] == "article":  # lists and boxes of links that an article holds are its own
                continue
            for k in range(a + 1, b):
                if total[k] and density[k] > LINKS_CUT and self.tag[k] in ("ul", "ol", "dl", "div", "section", "table") and total[k] < 0.5 * total[a]:
                    drop.append((k, self.end[k]))
        inside = bytearray(n)
        for a, b in chosen:
            inside[a:b] = bytes(not self.cut[k] for k in range(a, b))
        for a, b in drop:
            inside[a:b] = bytes(b - a)
        return " ".join("".join([t for node, t in self.texts if inside[node] or t == " "]).split())

    def _cut_named(self, worth: list[float]) -> None:
        """Cut the parts that their names tell, but for wrappers around what the page is about."""
        n = len(self.tag)
        whole = worth[:]
        for k in range(n - 1, 0, -1):
            whole[self.parent[k]] += whole[k]
        while True:
            outer, k = [], 1
            while k < n:
                if self.sign[k] in (NAMED, FIRMLY) and not self.cut[k]:
                    outer.append(k)
                    k = self.end[k]
                else:
                    k += 1
            rest = whole[0] - sum(whole[k] for k in outer)
            best = max(outer, key=lambda k: (whole[k], -k), default=0)
            if not best or not whole[best] or rest > (1e-9 if self.sign[best] == FIRMLY else REST_SHARE * whole[best]):
                break
            self.sign[best] = STAYS
        for k in outer:
            self.cut[k : self.end[k]] = [True] * (self.end[k] - k)

    def _siblings(self, node: int, n: int) -> list[int]:
        up, out = self.parent[node], []
        k = up + 1
        while k < self.end[up]:
            out.append(k)
            k = self.end[k]
        return out

    def _joins(self, k: int, score: list, total: list, density: list, least: float) -> bool:
        """Whether a sibling of the best container belongs to the text."""
        if self.cut[k] or not total[k]:
            return False
        if score[k] >= least or self.tag[k] in HEADINGS and density[k] < LINKS_TEXT:
            return True
        return self.tag[k] in ("p", "pre", "blockquote") and density[k] < LINKS_TEXT


def main_text(html: str) -> str:
    """Main text of one whole page."""
    return Tree(html).article() if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page; nothing is shuffled."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), as_text(F.col(html_col)).alias("html"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(main_text, batch.column(2).to_pylist()), pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
