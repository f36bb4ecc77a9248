"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end the text before them and after them.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that never belong to an article.
OUTSIDE = frozenset(
    "script style noscript template head title nav footer aside form button input select textarea iframe object embed applet canvas svg math dialog menu "
    "noembed noframes xmp search datalist audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of a class or id that mark what surrounds an article.
SURROUNDING = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar "
    "sidebar sidenav rail footer masthead breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond discussion cookie cookies consent "
    "gdpr notice notification popup modal overlay lightbox newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "trending popular widget toolbar pagination pager login signin search copyright disclaimer alert skip hidden paywall teaser".split())
#: Those of them that mark what readers write.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Words that mark a container of text.
CONTAINER = frozenset("article body content entry main page post story text blog hentry".split())
#: An open element is ended by these start tags.
ENDED_BY = {
    "p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "thead": frozenset({"tbody", "tfoot"}), "tbody": frozenset({"tbody", "tfoot"}), "head": frozenset({"body"}),
}
#: Start tags that end some open element.
ENDING = frozenset().union(*ENDED_BY.values())
#: An end is not looked for beyond these.
FENCE = frozenset({"table", "td", "th", "html", "body", "object", "article"})

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</[^a-zA-Z][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>", re.S)
_UNCLOSED = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
_MARK = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "out", "never", "words", "good", "first", "last", "start", "stop", "points", "inside", "link", "block")

    def __init__(self, tag: str, parent: Node | None, never: bool, words: set[str] | frozenset[str], good: int, number: int, text: int):
        self.tag, self.parent, self.good = tag, parent, good
        self.never, self.words, self.out = never, words, never  # no article whatever it holds; words of its class that speak against it
        self.link = tag == "a" or (parent is not None and tag not in BLOCK and parent.link)
        self.block = self if parent is None or tag in BLOCK else parent.block  # the block or root around it
        self.first = self.last = number  # of the nodes of its subtree
        self.start = self.stop = text  # of its texts
        self.points = 0.0
        self.inside = parent is not None and (parent.inside or tag in ("article", "main"))


def _marks(tag: str, rest: str, inside: bool) -> tuple[bool, set[str], int]:
    """Whether an element is out by its attributes, the words of its class or id that speak against it, and their bonus."""
    words, out = set(), False
    for name, value in _MARK.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words.update(w.lower() for w in _TOKEN.findall(value))
        elif name == "role":
            out |= value.lower() in ROLES
        elif name == "style":
            out |= bool(_HIDES.search(value))
        else:
            out |= value.lower() != "false"
    against = words & SURROUNDING | ({"header"} & words if not inside else set())
    top = tag in ("html", "body", "main")
    return out and not top, set() if top else against, 25 * bool(words & CONTAINER)


class Page:
    """A page's tree, its texts (block, node, text) in page order, and the main text."""

    def __init__(self, html: str):
        root = Node("#root", None, False, frozenset(), 0, 0, 0)
        self.nodes, self.texts, self.block = [root], [], 0
        self.open, self.held = [root], {}
        at, size, last = 0, len(html), html.rfind(">")
        while at < size:
            m = _MARKUP.search(html, at) if at <= last else _UNCLOSED.search(html, at)
            self.add(html[at : m.start() if m else size])
            if not m:
                break
            at = m.end()
            if m.re is _UNCLOSED:
                continue
            name = m["name"] or m["name2"]
            if name:
                name = name.lower()
                if m["end"] or m["end2"]:
                    self.end(name)
                else:
                    rest = m["rest"] if m["name"] else m["rest2"]
                    self.begin(name, rest)
                    if name in RAW:
                        stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                        at = stop.start() if stop else size
        while self.open:
            self.close()

    def add(self, text: str) -> None:
        if text:
            self.texts.append((self.block, self.open[-1], unescape(text)))

    def begin(self, tag: str, rest: str) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        for i in range(len(self.open) - 1, 0, -1) if tag in ENDING else ():
            held = self.open[i].tag
            if tag in ENDED_BY.get(held, ()):
                while len(self.open) > i:
                    self.close()
                break
            if held in BLOCK and held not in ("p",) and not (held in ENDED_BY and tag in ("tr", "tbody", "tfoot")):
                break
        if tag in BLOCK:
            self.block += 1
        if tag in VOID:
            if tag == "br":
                self.texts.append((self.block, self.open[-1], "\n"))
            return
        parent = self.open[-1]
        inside = parent.inside
        out, words, good = _marks(tag, rest, inside) if rest else (False, frozenset(), 0)
        node = Node(tag, parent, out or parent.never or tag in OUTSIDE or (tag == "header" and not inside), words, good, len(self.nodes), len(self.texts))
        self.nodes.append(node)
        self.open.append(node)
        self.held[tag] = self.held.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        for i in range(len(self.open) - 1, 0, -1) if self.held.get(tag) else ():
            held = self.open[i].tag
            if held == tag:
                while len(self.open) > i:
                    self.close()
                return
            if held in FENCE and tag not in FENCE and tag not in ("tr", "tbody", "thead", "tfoot", "div", "section", "main"):
                return

    def close(self) -> None:
        node = self.open.pop()
        self.held[node.tag] = self.held.get(node.tag, 0) - 1
        node.last, node.stop = len(self.nodes) - 1, len(self.texts)

    def blocks(self, of: list[Node]) -> list[str]:
        """The texts of some subtrees in page order, one item a block."""
        wanted, out, block, parts = sorted({(n.start, n.stop) for n in of}), [], None, []
        done = 0
        for start, stop in wanted:
            for b, node, text in self.texts[max(start, done) : stop]:
                if b != block:
                    out.append("".join(parts))
                    block, parts = b, []
                if not node.out:
                    parts.append(text)
            done = max(done, stop)
        out.append("".join(parts))
        return [t for t in (" ".join(x.split()) for x in out) if t]

    def judge(self, by_class: bool) -> None:
        """What is out: by element or attribute, and by class unless it holds the article.

        It holds the article if it is, or is around, the article or main element with most text (one that is not of a
        reader), or if it is named as a container and most of the page's text stands in it; nearly all, if it is named
        after comments too.
        """
        self.measure()
        plain = lambda n: self.letters[n.stop] - self.letters[n.start] - self.linked[n.stop] + self.linked[n.start]
        whole, spared = plain(self.nodes[0]), set()
        if by_class:
            marked = [n for n in self.nodes if n.tag in ("article", "main") and not n.never and not n.words & COMMENTS]
            for node in sorted(marked, key=lambda n: (-plain(n), n.first))[:1]:
                around = [node]
                while around[-1].parent is not None:
                    around.append(around[-1].parent)
                if 2 * plain(node) >= whole or not any(n.words & COMMENTS and not n.good for n in around[1:]):
                    spared.update(n.first for n in around)
        for node in self.nodes:
            bad = by_class and bool(node.words) and node.first not in spared
            if bad and node.good and whole and plain(node) >= (0.9 if node.words & COMMENTS else 0.5) * whole:
                bad = False
            node.out = node.never or bad or (node.parent is not None and node.parent.out)

    def measure(self) -> None:
        """Running sums of the letters of texts, of those in links, and of links."""
        self.letters, self.linked = [0], [0]
        for _, node, text in self.texts:
            n = 0 if node.out else len("".join(text.split()))
            self.letters.append(self.letters[-1] + n)
            self.linked.append(self.linked[-1] + (n if node.link else 0))
        self.links = [0]
        for node in self.nodes:
            self.links.append(self.links[-1] + (node.tag == "a"))

    def density(self, node: Node) -> float:
        n = self.letters[node.stop] - self.letters[node.start]
        return (self.linked[node.stop] - self.linked[node.start]) / n if n else 0.0

    def main(self) -> list[str]:
        """The main text; without regard to classes, if that leaves none."""
        self.judge(True)
        found = self.best()
        if not found and any(n.words for n in self.nodes):
            for node in self.nodes:
                node.out, node.points = node.never, 0.0
            self.judge(False)
            found = self.best()
        return found

    def best(self) -> list[str]:
        """Paragraphs pass points for length and commas to their ancestors; the best container and its siblings stay."""
        self.measure()
        for node in self.nodes:  # lists of links are menus
            if not node.out and node.tag in ("ul", "ol", "div", "table", "section", "dl") and self.density(node) >= 0.9:
                if self.links[node.last + 1] - self.links[node.first] > 2:
                    for n in self.nodes[node.first : node.last + 1]:
                        n.out = True
        candidates: dict[int, Node] = {}
        at = 0
        while at < len(self.texts):
            block, stop = self.texts[at][0], at
            while stop < len(self.texts) and self.texts[stop][0] == block:
                stop += 1
            own = [(n, t) for _, n, t in self.texts[at:stop] if not n.out]
            text = " ".join("".join(t for _, t in own).split())
            if len(text) >= 25:
                length = self.letters[stop] - self.letters[at]
                link = (self.linked[stop] - self.linked[at]) / max(1, length)
                points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - link)
                node = own[0][0].block
                # text right in a container scores it as a paragraph's parent would be
                node = node.parent if node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "dd") and node.parent else node
                for part in (1, 2, 6, 9, 12):
                    if node is None or node.tag in ("#root", "html"):
                        break
                    candidates[node.first] = node
                    node.points += points / part
                    node = node.parent
            at = stop
        for node in candidates.values():
            bonus = node.good + (25 if node.tag in ("article", "main") else 5 if node.tag in ("div", "section") else -3 if node.tag in ("ul", "ol", "dl", "li") else 0)
            node.points = (node.points + bonus) * (1 - self.density(node))
        if not candidates:
            own = [n for n in self.nodes if n.tag in ("article", "main") and not n.out] or [n for n in self.nodes if n.tag == "body"] or self.nodes[:1]
            return self.blocks(own)
        best = max(candidates.values(), key=lambda n: (n.points, -n.first))
        node, whole = best, None
        while node is not None:
            if node.tag in ("article", "main"):
                whole = node if whole is None or node.tag == "article" else whole
            node = node.parent
        best = whole or best
        kept = [best]
        if best.parent is not None and best.tag != "body":
            least = max(10.0, best.points * 0.2)
            for n in self.nodes[best.parent.first + 1 : best.parent.last + 1]:
                if n.parent is best.parent and n is not best and not n.out:
                    size, link = self.letters[n.stop] - self.letters[n.start], self.density(n)
                    if n.points >= least or n.tag == "p" and (size > 80 and link < 0.25 or size and not link) or n.tag in ("h1", "h2", "h3", "h4") and not link:
                        kept.append(n)
        return self.blocks(kept)


def main_text(html: str | None) -> str:
    return "\n\n".join(Page(html).main()) if html else ""


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Columns ``keep`` with ``text``: the main text of the whole page, its blocks joined by an empty line.

    Scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and reader comments are out by element,
    role, class or id; lists of links too.  Paragraphs of the rest pass points for length and commas to their ancestors,
    in full to the nearest and less to each above, discounted by link density; the best container (the whole article
    around it, where marked) stays with those siblings that score well or are plain paragraphs.  Character references are
    decoded and white space in a block is one space; no block of the container is dropped or cut.  A page without
    paragraphs gives what text its article or body has; a null or empty page gives the empty text, repeated rows the
    same, and an empty table none.  A class never takes out what holds the article, and none does if nothing would be
    left.  Unclosed and misnested tags are allowed, pages may be of any size.  An own column replaces a kept one of its name.
    """

    def make():
        return lambda column: [pa.array([main_text(h) for h in column.to_pylist()], pa.string())]

    return map_texts(pages, make, "text string", keep, html)
