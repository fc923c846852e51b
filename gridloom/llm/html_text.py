"""Main text of web pages by tree scoring.

The page's tree is built with HTML's implied end tags.  Subtrees that are not
prose by their tag, role or class (menus, adverts, forms, comments, ...) are cut,
but names are weak evidence: wrappers and names that only contain a cut word give
way to the page's prose, and ids made from headings don't count.
Each paragraph earns points for its length and commas; its container gets them
all and the containers above get shares; a container's points are discounted by
the share of its text that stands in links.  The container with most points is
kept, with siblings that score well or are plain prose; within an article's own
wrapper also short blocks and headings, and the heading above it.

The tree is built in time linear in the page: each element knows the paragraph,
item and block that it stands in, so no start or end tag walks the open elements
in vain.

Defined cases: a null or empty html has the empty text; a very long or deeply
nested page takes linear time and no recursion; broken markup ends where HTML
would end it; of containers with equal points the inner and earlier one is kept;
a null id or url stays null; repeated rows are extracted one by one; an empty table gives
an empty result.  Only the id, url and html columns are read, so other columns
can't clash.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import map_rows, text_or_empty

#: Fixed values of HTML: elements without content, with raw text, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption legend optgroup option".split()
)
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption option optgroup legend body html head".split())
#: What an element's start closes, and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Subtrees that hold no prose, by tag, by role, and by a word of class or id.
CUT_TAGS = frozenset("script style noscript template head nav aside footer button select input textarea iframe object embed svg canvas menu title audio video map".split())
CUT_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog menu menubar".split())
#: Cut unless the page's prose stands in them, by tag or role.
WRAPPERS = frozenset("form fieldset dialog".split())
#: Headings, and other elements that are named after one: a cut word in part of their id says nothing.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SECTIONS = HEADINGS | frozenset("article section p blockquote pre li dd dt figure table".split())
#: Characters of a block that is prose, and of prose that keeps a form beside other prose.
PROSE_CHARS, FORM_CHARS = 50, 500
CUT_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail aside footer masthead topbar toolbar ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo "
    "promotion promoted cookie cookies consent gdpr notice notices alert banner popup modal overlay lightbox newsletter subscribe subscription signup login comment comments commentlist disqus respond "
    "reply replies discussion share sharing social related recommended recommendations pagination pager widget widgets skip copyright legal disclaimer hidden".split()
)
#: Of these, the words of reader comments, which may be marked up as articles of their own.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Words that say nothing of a paragraph, list or section within an article.
SOFT_WORDS = frozenset("legal related discussion side social copyright disclaimer recommended recommendations".split())
#: Elements between which pages, not articles, are divided.
FRAME_TAGS = frozenset("nav header footer aside menu".split())
FRAME_WORDS = frozenset("nav navbar navigation menu menubar sidebar rail aside footer masthead topbar".split())
GOOD_WORDS = frozenset("article body content entry main post story text prose".split())
SCORED = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6".split())
#: Elements that a start tag of ``CLOSES`` looks for, and those in which an open paragraph is out of reach.
ITEMS = frozenset().union(*[shut | stop for shut, stop in CLOSES.values()])
KEEPS_P = frozenset("table td th button article section div li body blockquote".split())
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


class Node:
    """An element; ``children`` holds elements and strings."""

    __slots__ = ("tag", "words", "whole", "part", "good", "role", "hidden", "parent", "children", "holds", "score", "size", "linked", "commas", "prose", "text", "run", "run_linked", "p", "item", "block", "open", "in_article", "in_form", "framed")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.children, self.holds, self.score, self.framed = tag, parent, [], False, 0.0, False
        # The open paragraph and the nearest item or list in reach, the nearest block, and a block's open inline elements by tag.
        self.p = self if tag == "p" else None if parent is None or tag in KEEPS_P else parent.p
        self.item = self if tag in ITEMS or parent is None else parent.item
        ends = tag in BLOCKS or tag == "select" or parent is None
        self.block, self.open = (self, {}) if ends else (parent.block, None)
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.in_form = parent is not None and (parent.in_form or parent.tag == "form")
        self.words, self.whole, self.part, self.good, self.role, self.hidden = frozenset(), frozenset(), frozenset(), False, "", False
        if attributes and not attributes.isspace():
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            if named := f"{found.get('class', '')} {found.get('id', '')}".strip():
                self.words = frozenset(w.lower() for w in WORDS.findall(named))
                if self.words & CUT_WORDS:
                    self.sort_names(found.get("class", "").split(), found.get("id", ""))
            self.role = found.get("role", "").lower()
            self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()

    def sort_names(self, classes: list[str], slug: str) -> None:
        """The cut words of names that have no other words (``whole``) and of other names (``part``)."""
        whole, part = set(), set()
        for name in classes:
            words = {w.lower() for w in WORDS.findall(name)}
            (whole if words <= CUT_WORDS else part).update(words & CUT_WORDS)
            self.good = self.good or bool(words) and words <= GOOD_WORDS
        words = {w.lower() for w in WORDS.findall(slug)}
        if words <= CUT_WORDS and self.tag not in HEADINGS:
            whole |= words - {"discussion"} if self.tag in SECTIONS else words
        elif self.tag not in SECTIONS:
            part |= words & CUT_WORDS
        if self.tag in SECTIONS and self.in_article:
            whole, part = whole - SOFT_WORDS, part - SOFT_WORDS
        self.whole, self.part = frozenset(whole), frozenset(part)

    def is_never(self) -> bool:
        """Whether no text of the subtree can be the page's, whatever its amount."""
        if self.tag in CUT_TAGS or self.hidden or self.role in CUT_ROLES:
            return not (self.holds and self.tag in ("nav", "aside", "footer", "menu") and not self.hidden)
        if self.tag in ("html", "body", "main"):
            return False
        if self.whole & COMMENT_WORDS:
            return True
        return bool(self.part & COMMENT_WORDS) and not self.good and not (self.part & COMMENT_WORDS == {"discussion"})

    def is_cut(self, total: int) -> bool:
        """Whether the subtree is cut from a page with ``total`` characters of prose."""
        if self.is_never():
            return True
        most = 2 * self.prose > total
        if self.tag in CUT_TAGS:  # holds an article, as where its end tag is missing
            return not most
        if (self.tag in WRAPPERS or self.role in WRAPPERS) and not most:
            held = self.tag != "dialog" and self.role != "dialog" and (self.holds or self.prose >= FORM_CHARS)
            if not held:
                return True
        if self.tag in ("label", "legend"):  # fields' names
            return self.in_form
        if self.tag == "header":  # a page's, not an article's own heading
            return not self.in_article
        if not (self.whole or self.part) or self.tag in ("html", "body", "main"):
            return False
        if most and (self.good or not self.whole):
            return False
        if self.tag == "article":
            return not self.words & GOOD_WORDS
        if self.part & COMMENT_WORDS - {"discussion"}:
            return True
        if not self.whole and self.in_article:
            return 2 * self.prose <= self.text
        return not self.holds  # a layout named after its sidebar holds the article too


def ancestors(node: Node):
    while (node := node.parent) is not None:
        yield node


def build(page: str) -> Node:
    """The tree of a page."""
    root = now = Node("#root", "", None)
    at, size = 0, len(page)
    blocks: dict[str, int] = {}  # open blocks by tag

    def enter(node: Node) -> Node:
        held = blocks if node.open is not None else node.block.open
        held[node.tag] = held.get(node.tag, 0) + 1
        return node

    def leave(node: Node, last: Node) -> Node:
        """What is open once ``last`` and all in it are closed."""
        while True:
            (blocks if node.open is not None else node.block.open)[node.tag] -= 1
            if node is last:
                return node.parent
            node = node.parent

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            now.children.append(page[at:])
            break
        if m.start() > at:
            now.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<":
                now.children.append("<")
            elif m[0].startswith("<![CDATA["):
                now.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            ends = tag in BLOCKS or tag == "select"
            if (blocks if ends else now.block.open).get(tag):
                node = now
                while node.tag != tag:
                    node = node.parent
                now = leave(now, node)
            elif tag == "br":
                now.children.append(Node("br", "", now))
            continue
        if tag in CLOSES_P and now.p is not None:
            now = leave(now, now.p)
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            node = now.item
            while node.parent is not None and node.tag not in shut and node.tag not in stop:
                node = node.parent.item
            if node.tag in shut:
                now = leave(now, node)
        node = Node(tag, m[3], now)
        now.children.append(node)
        if tag in ("article", "main") and not (node.whole or node.part):
            for holder in ancestors(node):
                if holder.holds:
                    break
                holder.holds = True
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            stop = end.start() if end else size
            node.children.append(page[at:stop])
            close = page.find(">", stop)
            at = size if end is None or close < 0 else close + 1
            continue
        now = enter(node)
    return root


def plain(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


def weigh(root: Node) -> None:
    """Count each subtree's text and prose: the texts of blocks with some length and few links."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.prose = node.text = node.run = node.run_linked = 0
        todo += [c for c in node.children if isinstance(c, Node) and not c.is_never()]
    for node in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.run += own
        node.text += own
        if node.tag == "a":
            node.run_linked = node.run
        ends = node.tag in BLOCKS or node.parent is None
        if ends and node.run >= PROSE_CHARS and node.run_linked < 0.25 * node.run:
            node.prose += node.run
        if node.parent is not None:
            up = node.parent
            up.prose, up.text = up.prose + node.prose, up.text + node.text
            if not ends:
                up.run, up.run_linked = up.run + node.run, up.run_linked + node.run_linked


def measure(root: Node) -> list[Node]:
    """Cut subtrees, decode text and count characters, linked characters and commas; nodes from the leaves up."""
    weigh(root)
    total = root.prose
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        left = []
        for c in node.children:
            if isinstance(c, str):
                left.append(plain(c))
            elif not c.is_cut(total):
                left.append(c)
            elif c.tag in FRAME_TAGS or c.words & FRAME_WORDS:
                node.framed = True
        node.children = left
        todo += [c for c in node.children if isinstance(c, Node)]
    order.reverse()
    for node in order:
        node.size = node.linked = node.commas = 0
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip())
                node.commas += sum(map(c.count, ",،、，"))
            else:
                node.size, node.linked, node.commas = node.size + c.size, node.linked + c.linked, node.commas + c.commas
        if node.tag == "a":
            node.linked = node.size
    return order


def link_density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    order = measure(root)
    for node in order:
        own_text = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        paragraph = node.tag in SCORED or (node.tag in ("div", "section", "article", "main", "body", "#root") and own_text >= 25)
        if not paragraph or not node.size:
            continue
        length, commas = (node.size, node.commas) if node.tag in SCORED else (own_text, 0)
        points = 1 + commas + min(length / 100, 3)
        holder = node if node.tag not in SCORED else node.parent
        for level in range(4):
            if holder is None:
                break
            holder.score += points / (1, 2, 6, 9)[level]
            holder = holder.parent
    for node in order:
        if node.score:
            node.score += 25 * (node.tag in ("article", "main") or "articlebody" in node.words) + 10 * bool(node.words & GOOD_WORDS)
            node.score *= 1 - link_density(node)
    best = max(order, key=lambda n: n.score, default=root)
    if not best.score:
        marked = [n for n in order if n.tag in ("article", "main")]
        return [marked[-1] if marked else root]
    if best.parent is None or best.tag in ("body", "html", "#root"):
        return [best]
    least = max(10.0, best.score * 0.2)
    holder, kept = best.parent, []
    # A wrapper of the article alone, not of the page's parts, keeps its short blocks too.
    own = holder.tag not in ("body", "html", "#root") and not holder.framed
    for c in holder.children:
        if not isinstance(c, Node) or not c.size:
            continue
        few_links = link_density(c) < 0.25
        prose = c.tag in ("p", "blockquote", "pre") and c.size > 80 and few_links
        short = few_links and (own or c.tag in HEADINGS)
        if c is best or c.score >= least or prose or short or (c.tag == best.tag == "article"):
            kept.append(c)
    if not any(n.tag == "h1" for top in kept for n in elements(top)):  # the title, where it stands above the container's own wrapper
        inner = holder
        while inner.parent is not None and inner.parent.tag not in ("html", "#root"):
            above = [c for c in inner.parent.children if isinstance(c, Node)]
            titles = [c for c in above[: above.index(inner)] if c.tag == "h1" and c.size and link_density(c) < 0.25]
            if titles:
                return [titles[-1], *kept]
            inner = inner.parent
    return kept


def elements(top: Node):
    todo = [top]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in node.children if isinstance(c, Node)]


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks, each with single spaces."""
    out: list[str] = []
    run: list[str] = []

    def close():
        if text := SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    for top in nodes:
        close()
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            else:
                if x.tag in BLOCKS:
                    close()
                    todo.append(None)
                todo += reversed(x.children)
    close()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks, one a line."""
    return "\n".join(blocks(main_nodes(build(page)))) if page else ""


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url, text and n_chars of every row."""
    types = dict(df.dtypes)

    def fn(key, url, page):
        text = main_text(page)
        yield key, url, text, len(text)

    return map_rows(df.select(F.col(id_col), F.col(url_col), text_or_empty(html_col)), fn, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars bigint")
