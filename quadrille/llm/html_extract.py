"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements, and blocks of text (runs between block boundaries, with the
inline elements in them) as leaves. Every node is content or not. Node potentials come from its tag,
from what its class, id and role say, and for text from its length, links and place; a potential
for each pair (parent's label, child's label) connects a node to its parent, by the kind of the
child. Sum-product message passing, once upward and once downward, gives each node's exact
marginal, and the text blocks whose marginal is above one half are the main text.

The weights (html_weights.py) were trained by html_training.py from labelled pages.

Reading a page takes time in proportion to its length, whatever it holds.

Defined results: a null or empty page, or one without content, gives an empty text; broken markup
is repaired as browsers do (implied end tags, unknown end tags ignored, raw text up to its end tag),
but a tag that nothing closes is text; white space is what str.split takes for it, no-break spaces
included; repeated rows are extracted one by one; an empty table gives an empty table; other columns
are ignored; nothing is cut short.
"""

from __future__ import annotations

import re
from functools import cache
from html import unescape
from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_rows, table
from quadrille.llm.html_weights import WEIGHTS

_NAME_END = re.compile(r"[\s/>]")
#: The next attribute from inside a tag, or the tag's end. A quote that nothing closes is an ordinary character.
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
_SAYING = frozenset(["class", "id", "role", "aria-label"])
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
_DROPPED = frozenset("script style template noscript iframe object svg math canvas audio video title textarea select button datalist head".split())
_RAW = frozenset("script style template noscript iframe title textarea xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: A start tag ends an open element of these names, unless one of the second stands between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}

_GROUPS = {
    "nav": "nav", "menu": "nav", "header": "header", "hgroup": "heading", "footer": "footer", "aside": "aside", "article": "article", "main": "main", "section": "section", "form": "form", "fieldset": "form", "search": "form", "dialog": "dialog",
    "p": "p", "pre": "p", "blockquote": "quote", "figure": "figure", "figcaption": "figure", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "address": "address",
    "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "h1": "h1", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "body": "root", "html": "root",
}

#: What a class, id or role may say, by the start of one of its words (a dot: the whole word).
_SAYS = {
    "menu": "nav. navbar navigation navi menu breadcrumb toc. pagination pager skip topbar tabs",
    "header": "header head. masthead logo branding tagline topbar",
    "footer": "footer foot. colophon copyright legal imprint credits",
    "side": "sidebar side. aside complementary widget rail related recommend popular trending recent more. also. archive archives blogroll",
    "notice": "notice cookie consent gdpr privacy alert popup modal overlay banner. notification announcement paywall toast warning dialog alertdialog",
    "ad": "ad. ads. adv. advert advertisement sponsor sponsored promo promotion adsense adslot adbox adunit adsbygoogle dfp. outbrain taboola commercial",
    "comment": "comment comments comentarios kommentar commentaire disqus. reply replies respond discussion reader. readers. feedback",
    "form": "form. search searchform subscribe subscription newsletter signup login register contact. input",
    "share": "share sharing social. follow tags. tagcloud meta. byline author. rating print.",
    "content": "content. article post. entry main. story body. text. blog. prose page. container. wrapper. wrap.",
}
_WHOLE = {w[:-1]: k for k, v in _SAYS.items() for w in v.split() if w[-1] == "."}
_STEMS = [(w, k) for k, v in _SAYS.items() for w in v.split() if w[-1] != "."]
_known_words: dict[str, str | None] = {}


def _said(word: str) -> str | None:
    found = _known_words.get(word, 0)
    if found == 0:
        found = _WHOLE.get(word) or next((k for stem, k in _STEMS if word.startswith(stem)), None)
        if len(_known_words) < 100_000:
            _known_words[word] = found
    return found


class Page:
    """The tree in document order: a parent comes before its children.

    parent, kind and features by node; text by node, None for elements.
    """

    def __init__(self, html: str) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.features: list[list[str]] = []
        self.kind: list[str] = []
        self.text: list[str | None] = []
        self._build(html)

    def _add(self, parent: int, tag: str, features: list[str], kind: str, text: str | None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.features.append(features)
        self.kind.append(kind)
        self.text.append(text)
        return len(self.parent) - 1

    def _build(self, html: str) -> None:
        self._add(-1, "html", ["tag:root"], "plain", None)
        scan = _Scanner(html)
        open_ = _Open()
        #: The pieces of the current block, and the characters of it in links.
        run: list[str] = []
        links = 0

        def close_run() -> None:
            nonlocal links
            if run:
                text = " ".join(unescape("".join(run)).split())
                if text:
                    node = open_.node()
                    self._add(node, "#text", _text_features(text, links, self.tag[node]), "text", text)
                run.clear()
            links = 0

        def pop_to(k: int) -> None:
            if open_.blocks[-1] >= k:
                close_run()
            open_.pop_to(k)

        while True:
            piece, name, is_end, attributes = scan.next()
            if piece:
                run.append(piece)
                if open_.count("a"):
                    links += len(piece)
            if name is None:
                break
            if is_end:
                if name in ("html", "body"):
                    continue
                k = open_.last(name)
                # An inline end tag doesn't reach out of its block.
                if k and (name not in _INLINE or open_.blocks[-1] <= k):
                    pop_to(k)
                elif name == "p":
                    close_run()
                continue
            if name in _DROPPED and not scan.closed_itself:
                if name not in ("script", "style"):
                    run.append(" ")
                scan.skip(name)
                continue
            if name == "br":
                run.append(" ")
                continue
            if name in _VOID:
                if name == "hr":
                    close_run()
                continue
            says = _attribute_words(attributes) if attributes else ()
            if name in _CLOSES_P:
                k = max(open_.last("p"), open_.last("button"))
                if k:
                    pop_to(k)
                if _is_heading(name) and _is_heading(open_.names[-1]):
                    pop_to(len(open_.names) - 1)
            elif name in _IMPLIED:
                names, stop = _IMPLIED[name]
                k = max(map(open_.last, names))
                if k > max(map(open_.last, stop)):
                    pop_to(k)
            if name in _INLINE and not any(s not in ("content", "share", "header") for s in says):
                open_.push(name, -1, False)
                continue
            if name in ("html", "body"):
                close_run()
                if name == "body":
                    self.features[0] = ["tag:root", *(f"says:{s}" for s in says)]
                continue
            close_run()
            group = _GROUPS.get(name, "div")
            features = [f"tag:{group}", *(f"says:{s}" for s in sorted(says))]
            if "content" in says and len(says) > 1:
                features.remove("says:content")
            if group in ("article", "main") and not open_.regions:
                features.append(f"top:{group}")
            region = group in ("nav", "header", "footer", "aside", "form", "dialog") or any(s != "content" for s in says)
            open_.push(name, self._add(open_.node(), name, features, "region" if region else "plain", None), region)
        close_run()


def _is_heading(name: str) -> bool:
    return name[0] == "h" and name[1:].isdigit()


class _Open:
    """The open elements, with what is asked of them kept up to date.

    blocks: the places of those that are nodes; regions: how many are regions.
    """

    def __init__(self) -> None:
        self.names, self.nodes, self.is_region = ["html"], [0], [False]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.regions = [0], 0

    def push(self, name: str, node: int, region: bool) -> None:
        place = len(self.names)
        self.names.append(name)
        self.nodes.append(node)
        self.is_region.append(region)
        self.places.setdefault(name, []).append(place)
        if node >= 0:
            self.blocks.append(place)
            self.regions += region

    def pop_to(self, k: int) -> None:
        while len(self.names) > k:
            self.places[self.names.pop()].pop()
            if self.nodes.pop() >= 0:
                self.blocks.pop()
            self.regions -= self.is_region.pop()

    def last(self, name: str) -> int:
        """The place of the last open element of a name, or 0."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def count(self, name: str) -> int:
        return len(self.places.get(name, ()))

    def node(self) -> int:
        return self.nodes[self.blocks[-1]]


class _Scanner:
    """Text and tags in order. What was looked for once and isn't there is not looked for again."""

    def __init__(self, html: str) -> None:
        self.html, self.at, self.lower = html, 0, None
        self.last_gt = html.rfind(">")
        self.quotes = True
        self.closed_itself = False
        #: By name: where the content of nested elements that start at a place ends; names whose end tag doesn't come any more.
        self.ends: dict[str, dict[int, int]] = {}
        self.without_end: set[str] = set()

    def next(self) -> tuple[str, str | None, bool, list[tuple[str, str]]]:
        """The text up to the next tag, and the tag: its name (None at the end of the page), whether it is an end tag, its attributes."""
        html, start = self.html, self.at
        look = start
        while True:
            lt = html.find("<", look)
            if lt < 0 or lt > self.last_gt and not html.startswith("<!--", lt):
                self.at = len(html)
                return html[start:], None, False, []
            first = html[lt + 1 : lt + 2]
            if first in ("!", "?"):
                piece = html[start:lt]
                if html.startswith("<!--", lt):
                    m = _COMMENT_END.search(html, lt + 4)
                    self.at = m.end() if m else len(html)
                else:
                    self.at = html.index(">", lt) + 1
                if piece:
                    return piece, "!", True, []  # an end tag that nothing opens
                start = look = self.at
                continue
            is_end = first == "/"
            if not _LETTER.match(html, lt + 1 + is_end):
                look = lt + 1
                continue
            end = _NAME_END.search(html, lt + 2)
            if is_end:
                end = _NAME_END.search(html, lt + 3)
            name = html[lt + 1 + is_end : end.start()].lower()
            self.closed_itself = False
            attributes = self._attributes(end.start())
            return html[start:lt], name, is_end, attributes

    def _attributes(self, at: int) -> list[tuple[str, str]]:
        """Reads a tag to its end, from behind its name."""
        html, found, start = self.html, [], at
        while self.quotes:
            m = _ATTRIBUTE.match(html, at)
            if not m:  # the page ends in a quoted value that opened by mistake: from here on, tags end at the next >
                self.quotes = False
                break
            at = m.end()
            if m[1]:
                self.at = at
                self.closed_itself = html[at - 2] == "/"
                return found
            found.append((m[2].lower(), m[3] or m[4] or m[5] or ""))
        self.at = html.index(">", start) + 1
        self.closed_itself = html[self.at - 2] == "/"
        return []

    def skip(self, name: str) -> None:
        """Goes behind the content and end tag of a dropped element, whose start tag was read last; elements of the same name nest unless raw."""
        if name in self.without_end:
            if name in _RAW:
                self.at = len(self.html)
            return
        if self.lower is None:
            self.lower = _lowered(self.html)
        if name == "head":
            m = _HEAD_END.search(self.html, self.at)
            if m:
                self.at = m.end()
            else:
                self.without_end.add(name)
        elif name in _RAW:
            m = _pattern(rf"</{name}(?=[\s/>])").search(self.lower, self.at)
            if m and m.end() <= self.last_gt:
                self.at = self.html.index(">", m.end()) + 1
            else:
                self.without_end.add(name)
                self.at = len(self.html)
        else:
            if name not in self.ends:
                self.ends[name] = self._nested(name)
            self.at = self.ends[name].get(self.at, self.at)

    def _nested(self, name: str) -> dict[int, int]:
        """For each start tag of a name from here on that has an end tag: where its content begins, and where the end tag ends."""
        starts, ends, gt = [self.at], {}, self.at
        for m in _pattern(rf"<(/?){name}(?=[\s/>])").finditer(self.lower, self.at):
            if m.end() > self.last_gt:
                break
            if gt <= m.end():
                gt = self.html.index(">", m.end()) + 1
            if not m[1]:
                if self.html[gt - 2] != "/":
                    starts.append(gt)
            elif starts:
                ends[starts.pop()] = gt
        return ends


_COMMENT_END = re.compile(r"--!?>")
_LETTER = re.compile(r"[a-zA-Z]")
_HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.I)


@cache
def _pattern(text: str) -> re.Pattern:
    return re.compile(text)


def _lowered(html: str) -> str:
    """A-Z lower-cased, so that places stay."""
    return html.translate(_TO_LOWER)


_TO_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _attribute_words(attributes: list[tuple[str, str]]) -> set[str]:
    """What class, id, role and label say; a hidden element counts as a notice."""
    says = set()
    for name, value in attributes:
        if name in _SAYING:
            for word in _NAME.findall(value):
                said = _said(word.lower())
                if said:
                    says.add(said)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            says.add("notice")
    return says


def _text_features(text: str, links: int, parent: str) -> list[str]:
    n = len(text)
    size = "1" if n < 15 else "2" if n < 40 else "3" if n < 80 else "4" if n < 200 else "5"
    share = links / n
    linked = "0" if share < 0.05 else "1" if share < 0.35 else "2" if share < 0.8 else "3"
    group = _GROUPS.get(parent, "div")
    features = [f"links:{linked}", f"{group}:{size}", f"in:{group}"]
    if text[-1] in ".!?\"'”»…:":
        features.append("sentence")
    if "©" in text[:80]:
        features.append("copyright")
    return features


def node_odds(page: Page, weights: dict[str, float]) -> list[float]:
    get = weights.get
    return [sum([get(f, 0.0) for f in features]) for features in page.features]


def messages(parent: list[int], odds: list[float], edges: list[tuple[float, float, float, float]]) -> tuple[list[float], list[float]]:
    """Sum-product on the tree: the log odds of each node's marginal, and of its upward message.

    edges: for each node the potentials (parent 0 child 0, 0 1, 1 0, 1 1) with its parent.
    """
    total = list(odds)
    up = [0.0] * len(odds)
    for k in range(len(odds) - 1, 0, -1):
        a, b, c, d = edges[k]
        o = min(max(total[k], -50.0), 50.0)
        e = exp(o)
        up[k] = log((exp(c) + exp(d) * e) / (exp(a) + exp(b) * e))
        total[parent[k]] += up[k]
    for k in range(1, len(odds)):
        a, b, c, d = edges[k]
        o = min(max(total[parent[k]] - up[k], -50.0), 50.0)
        e = exp(o)
        total[k] += log((exp(b) + exp(d) * e) / (exp(a) + exp(c) * e))
    return total, up


def edge_potentials(weights: dict[str, float]) -> dict[str, tuple[float, float, float, float]]:
    return {kind: tuple(weights.get(f"{kind}:{x}", 0.0) for x in ("00", "01", "10", "11")) for kind in ("text", "plain", "region")}


def extract(html: str | None, weights: dict[str, float] = WEIGHTS, edges=None) -> str:
    """The main text: content blocks in page order, joined by one space."""
    if not html:
        return ""
    page = Page(html)
    edges = edges or edge_potentials(weights)
    total, _ = messages(page.parent, node_odds(page, weights), [edges[k] for k in page.kind])
    return " ".join([t for t, o in zip(page.text, total, strict=True) if t is not None and o > 0])


def main_text(pages: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    kind = dict(pages.dtypes)["page_id"]

    def make():
        edges = edge_potentials(weights)

        def work(html, key, url):
            text = extract(html, weights, edges)
            return key, url, text, len(text)

        return work

    return map_rows(pages, [F.col("html"), F.col("page_id"), F.col("url")], f"page_id {kind}, url string, text string, n_chars long", make)


def op9_html_extraction(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
