"""Main text of web pages by tree scoring.

A page becomes a tree the way browsers close what is left open. Paragraphs give points for length and commas,
less their share of link text, to their parent, half of them to the grandparent and a third to the next one.
The container with the most points, less its own link share, is kept with those siblings that score near it; where it stands in
an article element, the outermost one is kept with the other article elements that score near it, and in a main element that one.
Lists that are nearly all links go wherever they stand.

Menus, adverts, comments and the like are left out by element, role, and the names of class and id. Of a name its last part counts that
is not of a general kind ("list", "box"): a "social-policy" is a policy. Names that say what is not there ("no-sidebar") or that something
is on or off ("comments-open") do not count. What is named so and yet holds the page's article or nearly all of its prose is a wrapper and
stays; so does a form around an article.

Defined results: null and empty pages, and pages without text, give an empty text; without any scoring
paragraph the first article, main or body element is taken; repeated rows are each extracted; character
references are decoded once; other columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import append_column

# Elements of HTML by their role here, and words that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend option optgroup tbody tfoot thead tr".split())
SCOPE = frozenset("applet button caption html marquee object table td template th".split())
DROP = frozenset(
    "head script style noscript template iframe object embed svg canvas math audio video map nav footer aside button select textarea input menu search title datalist".split()
)
#: Elements of forms and dialogs: they go, unless they hold the article.
FORMS = frozenset("form fieldset label dialog".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip status".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar sidebars footer header masthead topbar cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription "
    "signup signin login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus popup modal overlay "
    "form search pagination pager paging toolbar widget widgets copyright legal disclaimer skip outbrain taboola paywall byline-tools".split()
)
#: Words that say what a block is wherever they stand in its name, and those that only reader comments have.
QUALIFIERS = frozenset("related recommended sponsored promoted popular trending".split())
READERS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: General parts of a name, which leave the part before them to say what a block is.
GENERAL = frozenset(
    "list lists box boxes wrapper wrap container area section block blocks inner outer left right top bottom item items link links holder bar row col column panel group buttons button icons icon slot unit title "
    "body content text module region zone".split()
)
#: Parts that say that something is absent, or belongs to a layout, and those that say that it is on or off.
ABSENT = frozenset("no not non without has with hide show".split())
STATES = frozenset("open opened closed off on enabled disabled active inactive visible hidden count".split())
#: An article's own header is one.
KEEP_WORDS = frozenset("article entry post story".split())
#: Share of the page's prose from which on a named block is a wrapper, and a form, and characters of it at least.
WRAPPER_SHARE, FORM_SHARE, LEAST_WRAPPED = 0.8, 0.5, 300
#: A list that is nearly all links: their share of its text, how many, and how long on average.
LINK_SHARE, LEAST_LINKS, LINK_LENGTH = 0.9, 3, 60
#: Points, as a share of the best, and characters from which on a second article belongs to the text.
NEAR_SHARE, LEAST_ARTICLE = 0.2, 250
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_START = re.compile(r"<(?=[!?]|/?[A-Za-z])")
_HEAD = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
#: Tags of a page that may fail to close before their ends are looked up step by step.
_FEW_FAILURES = 16
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HTML = re.compile(r"<html(?=[\s/>])", re.I)
_COMMAS = re.compile("[,،、，；;]")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "points", "text_length", "link_length", "links", "prose", "has_article", "dropped")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.text_length = self.link_length = self.links = self.prose = 0
        self.has_article = self.dropped = False


class _Tokens:
    """The comments, declarations and tags of a page, each as (start, end, CDATA, slash, name, attributes). A "<" whose tag never ends
    is text. Each such failure costs a scan of the page; after a few, quotes that are known to lead nowhere are remembered, so that
    any page takes time in proportion to its length."""

    def __init__(self, page: str) -> None:
        self.page, self.failures, self.dead = page, 0, set()

    def next(self, at: int) -> tuple[int, int, str | None, str | None, str | None, str] | None:
        page = self.page
        while begin := _START.search(page, at):
            at = begin.start()
            if self.failures < _FEW_FAILURES or page[at + 1] in "!?":
                if found := _TOKEN.match(page, at):
                    return at, found.end(), found[1], found[2], found[3], found[4]
                self.failures += 1
            elif (head := _HEAD.match(page, at)) and (end := self._end(head.end())) is not None:
                return at, end + 1, None, head[1], head[2], page[head.end() : end]
            at += 1
        return None

    def _end(self, at: int) -> int | None:
        """The place of the ">" that ends a tag, outside quotes."""
        seen = []
        while special := _SPECIAL.search(self.page, at):
            place = special.start()
            if special[0] == ">":
                return place
            if place in self.dead:
                break
            seen.append(place)
            at = self.page.find(special[0], place + 1) + 1
            if not at:
                break
        self.dead.update(seen)
        return None


def html_tags(page: str) -> Iterator[str]:
    """The attributes of each html start tag, wherever it stands; comments and raw elements hold none."""
    last = max((m.start() for m in _HTML.finditer(page)), default=-1)
    at, tokens = 0, _Tokens(page)
    while at <= last:
        found = tokens.next(at)
        if found is None:
            return
        _, at, _, slash, name, attributes = found
        if name is None or slash:
            continue
        tag = name.lower()
        if tag == "html":
            yield attributes
        elif tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)


def parse(page: str) -> Node:
    """The page's tree. A start tag closes what cannot hold it; an end tag closes up to its start tag, and
    one of an inline element does not reach through a block."""
    root = now = Node("#root", "", None)
    at, end, tokens = 0, len(page), _Tokens(page)
    opened: Counter[str] = Counter()  # open elements by name: an end tag without one is not searched for

    def back(to: Node) -> Node:
        node = now
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return to

    def close_open(tags: tuple[str, ...], scope: frozenset[str]) -> Node:
        return back(_close_open(now, tags, scope)) if any(opened[t] for t in tags) else now

    while at < end:
        found = tokens.next(at)
        if found is None:
            now.children.append(page[at:])
            break
        start, stop_at, cdata, slash, name, attributes = found
        if start > at:
            now.children.append(page[at:start])
        at = stop_at
        if cdata is not None:
            now.children.append(cdata)
            continue
        if name is None:
            continue
        tag = name.lower()
        if slash:
            if opened[tag]:
                now = back(_close(now, tag))
            continue
        if tag in CLOSES_P:
            now = close_open(("p",), SCOPE)
        if tag == "li":
            now = close_open(("li",), SCOPE | {"ul", "ol", "menu", "dir"})
        elif tag in ("dt", "dd"):
            now = close_open(("dt", "dd"), SCOPE | {"dl"})
        elif tag in ("td", "th"):
            now = close_open(("td", "th"), frozenset(("tr", "table")))
        elif tag in ("tr", "tbody", "thead", "tfoot"):
            now = close_open(("tr",), frozenset(("table",)))
        elif tag in HEADINGS and now.tag in HEADINGS or tag == "option" and now.tag == "option":
            now = back(now.parent)
        node = Node(tag, attributes, now)
        now.children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            node.children.append(page[at : stop.start()] if stop else page[at:])
            at = stop.end() if stop else end
        elif tag not in VOID and not _SELF_CLOSED.search(attributes) or tag in BLOCK and tag not in VOID:
            now = node
            opened[tag] += 1
    return root


def _close(now: Node, tag: str) -> Node:
    inline = tag not in BLOCK and tag not in ("td", "th")
    node = now
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if inline and node.tag in BLOCK or node.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html", "article", "main"):
            return now
        node = node.parent
    return now


def _close_open(now: Node, tags: tuple[str, ...], scope: frozenset[str]) -> Node:
    node = now
    while node.parent is not None and node.tag not in scope:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return now


def unwanted_name(name: str) -> str | None:
    """The word of a class or id that says that a block is no part of the article."""
    parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p]
    parts = [p.lower() for p in parts]
    if not parts or parts[0] in ABSENT or parts[-1] in STATES:
        return None
    for p in parts:
        if p in QUALIFIERS:
            return p
    while len(parts) > 1 and (parts[-1] in GENERAL or parts[-1].isdigit()):
        parts.pop()
    if parts[-1] not in DROP_WORDS or parts[-1] == "header" and KEEP_WORDS.intersection(parts):
        return None
    return parts[-1]


def _unwanted(node: Node) -> str | None:
    """Why a node is no part of the article: "element", "form", "hidden", "role", or the word of a name; None if nothing says so."""
    if node.tag in DROP:
        return "element"
    if node.tag in ("html", "body", "main", "#root"):
        return None
    if node.tag in FORMS:
        return "form"
    if node.tag == "header":  # a page's header goes; an article's own keeps its headings, see blocks()
        up = node.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return None if up is not None else "element"
    if not node.attributes or node.attributes.isspace():
        return None
    why = None
    for name, a, b, c in _ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return "hidden"
        if name == "role" and value.strip().lower() in DROP_ROLES:
            why = why or "role"
        if name in ("class", "id"):
            for word in filter(None, map(unwanted_name, value.split())):
                if word in READERS:
                    return word
                why = why or word
    return why


def _is_prose(node: Node, inner: bool) -> bool:
    """Whether a node's own text is a paragraph's; inner: blocks stand in it."""
    return not inner and node.tag in ("p", "pre", "blockquote", "td", "li", "dd", "div", "section", "article", "main") and node.text_length >= 25 and _links(node) < 0.5


def _measure(root: Node) -> list[Node]:
    """All nodes that are kept, parents first, with text and link lengths and prose; unwanted ones are marked."""
    every, todo = [], [root]
    while todo:
        node = todo.pop()
        node.dropped = node.tag in DROP
        if not node.dropped:
            every.append(node)
            todo += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(every):
        _sum_up(node)
    # what a block's prose is a share of: the article or main element around it, or the page's where none has such an element; of more than a few words
    order: list[Node] = []
    whole = 0 if any(n.tag in ("article", "main") for n in every) else root.prose
    open_ = [(root, whole)]
    while open_:
        node, total = open_.pop()
        holds = lambda share: total and node.prose >= max(LEAST_WRAPPED, share * total)  # noqa: B023, E731
        why = "element" if node.dropped else _unwanted(node)
        if why == "form":
            node.dropped = not (node.has_article or holds(FORM_SHARE))
        elif why == "element":
            node.dropped = True
        elif why is not None:
            node.dropped = not (node.has_article or why not in READERS and holds(WRAPPER_SHARE))
        if node.tag in ("ul", "ol", "div", "section", "table") and node.links >= LEAST_LINKS and _links(node) >= LINK_SHARE and node.link_length <= LINK_LENGTH * node.links:
            node.dropped = True
        if not node.dropped:
            order.append(node)
            total = node.prose if node.tag in ("article", "main") else total
            open_ += [(c, total) for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        _sum_up(node)
    return order


def _sum_up(node: Node) -> None:
    below = [c for c in node.children if not isinstance(c, str) and not c.dropped]
    node.text_length = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str)) + sum(c.text_length for c in below)
    node.link_length = node.text_length if node.tag == "a" else sum(c.link_length for c in below)
    node.links = (node.tag == "a") + sum(c.links for c in below)
    node.has_article = any(c.has_article or c.tag in ("article", "main", "h1") for c in below)
    inner = any(c.tag in BLOCK for c in below)
    node.prose = node.text_length if _is_prose(node, inner) else sum(c.prose for c in below)


def _links(node: Node) -> float:
    return node.link_length / node.text_length if node.text_length else 0.0


def _text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped:
            todo += reversed(x.children)
    return " ".join(out)


def best_container(root: Node) -> list[Node]:
    """The nodes whose text is the article's, in page order."""
    order = _measure(root)
    for node in order:
        blocks_below = any(not isinstance(c, str) and c.tag in BLOCK for c in node.children)
        if not (node.tag in ("p", "pre", "blockquote", "td", "li", "dd") or node.tag in ("div", "section", "article", "main")) or blocks_below or node.text_length < 25:
            continue
        points = (1 + len(_COMMAS.findall(_text(node))) + min(node.text_length // 100, 3)) * (1 - _links(node))
        up, share = node.parent if node.tag not in ("div", "section", "article", "main") else node, 1.0
        for share in (1.0, 1 / 2, 1 / 3):
            if up is None or up.dropped:
                break
            up.points += points * share
            up = up.parent
    scored = [n for n in order if n.points > 0 and n.tag not in ("#root", "html")]
    if not scored:
        for tag in ("article", "main", "body", "#root"):
            for n in order:
                if n.tag == tag and n.text_length:
                    return [n]
        return []
    best = max(scored, key=lambda n: n.points * (1 - _links(n)))
    article = main = None
    up = best
    while up is not None:
        article = up if up.tag == "article" else article
        main = main or (up if up.tag == "main" else None)
        up = up.parent
    if article is not None:
        # the sum of what paragraphs below give, wherever they stand in it
        worth = lambda n: sum(x.points for x in _below(n)) * (1 - _links(n))
        outer = [n for n in order if n.tag == "article" and not _inside(n, "article")]
        least = NEAR_SHARE * worth(article)
        near = {id(n) for n in outer if n is article or n.text_length >= LEAST_ARTICLE and worth(n) >= least}
        return [n for n in order if id(n) in near] if len(near) < 2 else sorted((n for n in outer if id(n) in near), key=_place)
    if main is not None:
        return [main]
    least = max(10.0, 0.2 * best.points)
    kept, before = [], True
    for s in best.parent.children if best.parent else [best]:
        if isinstance(s, str) or s.dropped:
            continue
        if s is best:
            before = False
            kept.append(s)
        elif s.points * (1 - _links(s)) >= least or s.tag == "p" and s.text_length > 80 and _links(s) < 0.25 or before and s.tag in ("h1", "h2"):
            kept.append(s)
    return kept


def _below(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in x.children if not isinstance(c, str) and not c.dropped]


def _inside(node: Node, tag: str) -> bool:
    up = node.parent
    while up is not None and up.tag != tag:
        up = up.parent
    return up is not None


def _place(node: Node) -> list[int]:
    """Where a node stands in its page."""
    out = []
    while node.parent is not None:
        out.append(next(k for k, c in enumerate(node.parent.children) if c is node))
        node = node.parent
    return out[::-1]


def blocks(nodes: list[Node]) -> list[str]:
    """The text of each block of the nodes, in page order, with references decoded and white space as one space."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(map(html.unescape, now)).split())
        if text:
            out.append(text)
        now.clear()

    def walk(top: Node) -> None:
        todo: list[tuple[Node | str | None, bool]] = [(top, False)]
        while todo:
            x, headings_only = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                if not headings_only:
                    now.append(x)
            elif not x.dropped:
                only = x.tag == "header" or headings_only and x.tag not in HEADINGS
                if x.tag == "br":
                    now.append(" ")
                elif x.tag in ("td", "th"):
                    now.append(" ")
                elif x.tag in BLOCK:
                    flush()
                    todo.append((None, False))
                todo += [(c, only) for c in reversed(x.children)]

    for node in nodes:
        walk(node)
        flush()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(best_container(parse(page)))) if page else ""


def extract(pages: DataFrame, page: str = "html", name: str = "main_text") -> DataFrame:
    """pages with one more string column, the main text of each page."""

    return append_column(pages, page, name, T.StringType(), main_texts)


def main_texts(column: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in _each(column)], pa.string())


def _each(column: pa.Array) -> Iterator[str | None]:
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def digest(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"), "html", "text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
