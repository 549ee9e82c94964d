"""Main text of web pages by tree scoring (operator 3).

A page is read into a tree, with the implied ends of HTML. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are cut off by tag, role and the words of class and id. Every paragraph passes points, for its length and commas, to its ancestors,
fewer with each level; a container's points are discounted by its share of link text. The best container is kept with
its siblings that are no lists of links, and their blocks are the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm.common import read

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript template svg math".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption""".split())
DROP = frozenset("""head nav footer header aside form button select option input textarea label fieldset menu dialog script style iframe noscript template svg math
object applet canvas audio video map title xmp noembed noframes""".split())
#: Of these, the ones that pages also put around the whole article, and those whose text never is the article's.
AROUND = frozenset("form fieldset label".split())
CONTROLS = DROP - AROUND - {"header"}
DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form tablist status".split())
#: Words of a class or an id that mark what is not the article.
DROP_WORD = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login footer foot header masthead topbar menu menubar nav navbar
navigation navi pager pagination paginate promo promoted promotion related recommend recommended recommendations share sharing social sidebar sidebars sponsor sponsored
sponsors widget widgets toolbar skip skyscraper outbrain taboola""".split())
#: Words that may stand beside such a word in one name ("site-footer", "ad-slot-2"); beside any other word it says something else
#: ("related-work", "share-of-market").
BESIDE_WORD = frozenset("""site main page top bottom left right global primary secondary container wrapper wrap box block inner outer area bar list links link section col row
button buttons icon icons slot unit item items group holder text mobile desktop fixed sticky widget wp td js mw bs md lg sm xs post entry article content
form panel region module zone strip inline title label message msg trail posts articles stories reading news more videos products topics fluid large small dark light""".split())
READER_WORD = frozenset("disqus respond replies reply remark remarks shoutbox".split())
#: Beside a comment word, words that tell a state of the article ("comments-open", "has-comments").
STATE_WORD = frozenset("open opened closed has have no with without enabled disabled allow allowed status".split())
#: Length of text beside a large block of reader comments from which that text is the article.
BESIDE = 100
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table html body article section div main".split())
PARTS = frozenset("tr td th tbody thead tfoot table ul ol dl li dt dd p".split())
TAG_POINTS = {"article": 10, "main": 10, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "dd": -3, "dt": -3}
LEVELS = 6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "length", "linked", "commas", "article", "words", "reader", "prose", "clean", "own", "block", "scope", "cell")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children, self.points = tag, attrs, parent, [], 0.0
        # The nearest block around, or the node itself; the same for the elements that hold lists and tables, and for those that hold paragraphs.
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.scope = self if parent is None or tag in SCOPE else parent.scope
        self.cell = self if parent is None or tag in SCOPE or tag in ("td", "th", "li") else parent.cell


class Opened:
    """The element that is open, and how many are open around it by where a search for them may look, so that no search goes on in vain: every
    step up a search makes closes an element, and parsing takes linear time."""

    def __init__(self, root: Node):
        self.top, self.count = root, Counter()

    def _keys(self, node: Node) -> tuple:
        up = node.parent
        return node.tag, (up.block, node.tag), (up.scope, node.tag, "scope"), (up.cell, node.tag, "cell")

    def push(self, node: Node) -> None:
        self.count.update(self._keys(node))
        self.top = node

    def close(self, node: Node) -> None:
        """``node`` and all that is open inside it end."""
        while True:
            last, self.top = self.top, self.top.parent
            self.count.subtract(self._keys(last))
            if last is node:
                return

    def end(self, tag: str) -> None:
        """An end tag. That of an inline element does not end a block around it; one without a start is passed over."""
        inline = tag not in BLOCK and tag not in ("td", "th")
        if not self.count[(self.top.block, tag) if inline else tag] > 0:
            return
        node = self.top
        while node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.close(node)

    def imply(self, tag: str) -> None:
        """The elements that a start tag ends: an open paragraph, items and cells."""
        if tag in BLOCK and self.count[(self.top.cell, "p", "cell")] > 0:
            node = self.top
            while node.tag != "p":
                node = node.parent
            self.close(node)
        ends = CLOSES.get(tag, ())
        while any(self.count[(self.top.scope, t, "scope")] > 0 for t in ends):
            node = self.top
            while node.tag not in ends:
                node = node.parent
            self.close(node)
            if node.tag == tag or tag != "tr":
                break


def parse(source: str) -> Node:
    """Tree of a page; never fails, and nothing nests deeper than the tags do."""
    root = Node("html", {}, None)
    opened = Opened(root)
    ends: dict[str, re.Pattern] = {}
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            opened.top.children.append(source[at:])
            break
        if m.start() > at:
            opened.top.children.append(source[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            opened.end(tag)
            continue
        rest = m[3] or m[6] or ""
        opened.imply(tag)
        if tag == "html":
            continue
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(rest)} if "=" in rest or "hidden" in rest.lower() else {}
        node = Node(tag, attrs, opened.top)
        opened.top.children.append(node)
        if tag in RAW:
            if rest.rstrip().endswith("/"):
                continue
            # An element of raw text that nothing ends is searched for once.
            pattern = ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I))
            end = pattern.search(source, at) if pattern is not None else None
            if end:
                at = source.find(">", end.end())
                at = n if at < 0 else at + 1
            else:
                ends[tag] = None
                if tag in ("script", "style"):
                    at = n
        elif tag not in VOID:
            opened.push(node)
    return root


def judge(nodes: list[Node]) -> None:
    """What ``unwanted`` asks of every node (parents first): words of class and id; reader, 2 if they mark reader comments and 1 if
    only a state of them; prose, the length of text outside links and controls; clean, prose without marked parts; own, the
    number of articles inside that are no comments."""
    for node in reversed(nodes):
        node.words, node.reader = frozenset(), 0
        for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split() if node.attrs else ():
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & READER_WORD or any(w.startswith("comment") for w in words):
                node.reader = max(node.reader, 1 if words & STATE_WORD else 2)
            if words & DROP_WORD and words <= DROP_WORD | BESIDE_WORD:
                node.words |= words
        node.prose = node.clean = node.own = 0
        for c in node.children:
            if isinstance(c, str):
                node.prose += len(c.strip())
                node.clean += len(c.strip())
            elif c.tag not in CONTROLS:
                node.prose += c.prose
                node.clean += counted(c)
                node.own += articles(c)
        if node.tag == "a":
            node.prose = node.clean = 0


def counted(node: Node) -> int:
    """Clean text that a node gives to its parent."""
    return 0 if node.tag in CONTROLS or node.reader == 2 or node.words & DROP_WORD else node.clean


def articles(node: Node) -> int:
    """Articles that are no comments, the node itself included."""
    return 0 if node.tag in CONTROLS or node.reader == 2 else node.own + (node.tag in ("article", "main"))


def unwanted(node: Node, inside: bool, wraps: bool, most: bool, beside: tuple[int, int]) -> bool:
    """Whether a subtree is no part of the article; inside: an article or main element is around it; wraps: it holds one, or
    most of the page's text; most: it holds most of the prose; beside: clean text and articles outside of it."""
    a, tag = node.attrs, node.tag
    around = most or node.own > 0
    if tag in AROUND:
        if not around:
            return True
    elif tag in DROP:
        return not (tag == "header" and inside)
    if not a:
        return False
    style = a.get("style", "").replace(" ", "").lower()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    role = a.get("role", "").lower()
    if role in DROP_ROLE and not (role == "form" and around):
        return True
    if tag in ("body", "main"):
        return False
    if node.reader == 1 and not (around or tag == "article"):
        return True
    # A wrapper named for the comments it also holds is around the article; reader comments are beside it, however long.
    if node.reader == 2 and not (node.own and not beside[1] or most and beside[0] < BESIDE):
        return True
    if tag == "article":
        return bool(node.words & {"ad", "advert", "promo", "related"})
    # A wrapper named for what stands beside the article ("has-sidebar") is not that.
    return bool(node.words & DROP_WORD) and not wraps


def prune(root: Node) -> None:
    """Cut off what is no part of the article; of a header inside it the headings stay."""
    nodes = measure(root)
    judge(nodes)
    total, prose = root.length, root.prose
    stack = [(root, False, 0, 0)]
    while stack:
        node, inside, clean, own = stack.pop()
        inside = inside or node.tag in ("article", "main") or node.attrs.get("role", "").lower() in ("main", "article")
        kept = []
        for c in node.children:
            if isinstance(c, str):
                if node.tag != "header":
                    kept.append(c)
                continue
            beside = clean + node.clean - counted(c), own + node.own - articles(c) + (node.tag in ("article", "main"))
            if not unwanted(c, inside, c.article or 2 * c.length > total, 2 * c.prose > prose, beside) and (node.tag != "header" or c.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "div", "hgroup")):
                kept.append(c)
                stack.append((c, inside, *beside))
        node.children = kept


def measure(root: Node) -> list[Node]:
    """Text length, link text, commas and whether an article is inside, of every node; returns the nodes, parents first."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    for node in reversed(nodes):
        node.length = node.linked = node.commas = 0
        node.article = False
        for c in node.children:
            if isinstance(c, str):
                node.length += len(c.strip())
                node.commas += c.count(",") + c.count("，") + c.count("、")
            else:
                node.length += c.length
                node.linked += c.linked
                node.commas += c.commas
                node.article |= c.article or c.tag in ("article", "main")
        if node.tag == "a":
            node.linked = node.length
    return nodes


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def best_container(root: Node) -> list[Node]:
    """The nodes whose blocks are the article, in page order."""
    nodes = measure(root)
    scored: dict[int, Node] = {}
    for node in nodes:
        inner = any(not isinstance(c, str) and c.tag in BLOCK for c in node.children)
        if not node.length or node.tag not in ("p", "pre", "td", "blockquote", "div", "section", "article", "main", "li", "dd") or inner:
            continue
        points = (1 + node.commas + min(node.length / 100, 3)) * (1 - density(node)) * (1 if node.tag not in ("li", "dd") else 0.3)
        up, level = node.parent, 0
        while up is not None and level < LEVELS:
            if id(up) not in scored:
                scored[id(up)] = up
                up.points = TAG_POINTS.get(up.tag, 0)
            up.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1
    if not scored:
        return [root]
    value = {k: v.points * (1 - density(v)) for k, v in scored.items()}
    best = max(scored.values(), key=lambda v: value[id(v)])
    while best.tag in PARTS and best.parent is not None:  # a table or list is part of what holds it
        best = best.parent
    value.setdefault(id(best), 0.0)
    node = best
    while node is not None:  # the whole article around the best part of it
        if node.tag in ("article", "main") or node.attrs.get("role", "").lower() in ("main", "article"):
            best = node
        node = node.parent
    if best.parent is None or best.tag in ("body", "article", "main"):
        alike = [v for v in scored.values() if v.tag == "article" and best.tag == "article" and v.parent is best.parent]
        return alike if len(alike) > 1 else [best]
    return [c for c in best.parent.children if not isinstance(c, str) and (c is best or c.length and density(c) < 0.5 and not boilerplate(c))]


def boilerplate(node: Node) -> bool:
    """A short line of rights or terms, which pages put beside the article without a name."""
    if node.length > 200:
        return False
    text = " ".join(blocks([node])).lower()
    return text.startswith(("©", "(c) ", "copyright ")) or "all rights reserved" in text


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks under the nodes, in page order, white space as one space; empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            if text := " ".join(html.unescape("".join(line)).split()):
                out.append(text)
            line.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        else:
            if x.tag in ("br", "td", "th", "wbr", "img"):
                line.append("" if x.tag == "wbr" else " ")
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.children))
    end()
    return out


def main_text(source: str | None) -> str:
    """Blocks of the main text of one page, joined by line ends; empty for null, blank and textless pages."""
    if not source:
        return ""
    root = parse(source)
    prune(root)
    return "\n".join(blocks(best_container(root)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with columns text and n_chars (code points) beside those it has; of these, ones with such names are replaced.

    Null, empty and textless pages have an empty text and 0; repeated rows are each read, ids are not used, an empty table stays empty. A
    page of any length is read whole, in time linear in it.
    """
    @F.pandas_udf("string")
    def udf(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in pages], dtype=object)
    return pages.withColumn("text", udf(F.col(html_col).cast("string"))).withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, whole."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: A plain reading of the article element, which all given pages have, with the character references that stand in it.
OP3_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS article FROM pages),
b AS (SELECT page_id, url, unnest(regexp_split_to_array(article, '</?(?:p|h1)>')) AS block, generate_subscripts(regexp_split_to_array(article, '</?(?:p|h1)>'), 1) AS k FROM a),
t AS (SELECT page_id, url, k, regexp_replace(block, '<[^>]*>', ' ', 'g') AS x FROM b),
u AS (SELECT page_id, url, k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line FROM t),
j AS (SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (line <> ''), '') AS text FROM u GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j
"""
