"""Trains the weights of html_extract from labelled pages: python -m quadrille.llm.html_training

The labelled pages are composed at random from a list of layouts, so accuracy on more such pages says
little of pages with other layouts; trained on every second layout only, it can be measured on the
ones left out. Each text block
is written as content or not, and an element is content if any block in it is. Training
maximises the regularised likelihood of all node labels given the tree; its gradient needs the node
and pair marginals, which the same message passing gives.
"""

from __future__ import annotations

import random
from math import exp
from pathlib import Path

from quadrille.llm.html_extract import Page, edge_potentials, messages, node_odds

CONTENT, OTHER = "oak", "zinc"  # a block's label is its first word


class _Writer:
    """Pieces of a random page. half: 0 or 1 to use only every second layout of each list of them, None for all."""

    def __init__(self, seed: int, half: int | None = None) -> None:
        self.r, self.half = random.Random(seed), half

    def words(self, low: int, high: int, mark: str) -> str:
        out = [mark]
        for _ in range(self.r.randint(low, high)):
            out.append("".join(self.r.choices("etaoinshrdlu", k=self.r.randint(2, 9))))
            if self.r.random() < 0.08:
                out[-1] += self.r.choice([",", ",", ";", "."])
        return " ".join(out)

    def prose(self, mark: str, low: int = 8, high: int = 90) -> str:
        text = self.words(low, high, mark) + self.r.choice([".", ".", ".", "!", "?", ""])
        if self.r.random() < 0.25:
            text = text.replace(" ", ' <a href="/x">', 1).replace(" ", " ", 1) + "</a>" if len(text) < 60 else text[: len(text) // 2].rstrip() + ' <a href="#">see</a> ' + text[len(text) // 2 :].lstrip()
        return text

    def maybe(self, share: float, what: str) -> str:
        return what if self.r.random() < share else ""

    def pick(self, *choices: str) -> str:
        return self.r.choice(self._allowed(choices))

    def _allowed(self, choices):
        return choices if self.half is None or len(choices) < 2 else choices[self.half :: 2]

    def _weighed(self, choices: list[str], weights: list[float]) -> str:
        return self.r.choices(self._allowed(choices), weights=self._allowed(weights))[0]

    def links(self, mark: str, n: int) -> str:
        items = [f'<li><a href="/{k}">{self.words(0, 3, mark)}</a></li>' for k in range(n)]
        return f"<ul>{''.join(items)}</ul>"

    def nav(self) -> str:
        body = self.links(OTHER, self.r.randint(2, 8))
        flat = " | ".join(f'<a href="/{k}">{self.words(0, 1, OTHER)}</a>' for k in range(self.r.randint(2, 6)))
        return self.pick(f"<nav>{body}</nav>", f'<div class="{self.pick("menu", "main-menu", "navbar", "site-navigation", "breadcrumbs")}">{self.pick(body, flat)}</div>', f'<ul id="nav">{body[4:-5]}</ul>', f'<div role="navigation">{flat}</div>', body)

    def header(self) -> str:
        inside = self.pick(f"<h1>{self.words(0, 4, OTHER)}</h1>", f"<p>{self.words(1, 8, OTHER)}</p>", f'<a href="/">{self.words(0, 2, OTHER)}</a>', f"<div>{self.words(0, 5, OTHER)}</div>")
        inside += self.maybe(0.4, self.nav()) + self.maybe(0.2, f"<p>{self.prose(OTHER, 5, 25)}</p>")
        return self.pick(f"<header>{inside}</header>", f'<div id="{self.pick("header", "masthead", "banner", "top-header")}">{inside}</div>', f'<div role="banner" class="site-header">{inside}</div>')

    def footer(self) -> str:
        inside = self.pick(f"&copy; {self.words(1, 12, OTHER)}", f"<p>{self.prose(OTHER, 3, 40)}</p>", f"<p>&copy; 2020 {self.words(1, 6, OTHER)}</p>{self.links(OTHER, 3)}", self.words(2, 30, OTHER))
        return self.pick(f"<footer>{inside}</footer>", f"<footer>{inside}</footer>", f'<div class="{self.pick("footer", "site-footer", "copyright", "legal")}">{inside}</div>', f'<div id="footer">{inside}</div>')

    def ad(self) -> str:
        inside = self.pick(self.prose(OTHER, 3, 60), f"<p>{self.prose(OTHER, 3, 40)}</p>", f'<a href="/buy">{self.words(1, 8, OTHER)}</a>', f"<h3>{self.words(0, 4, OTHER)}</h3><p>{self.prose(OTHER, 5, 40)}</p>")
        return f'<{(t := self.pick("div", "div", "div", "section", "aside"))} class="{self.pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor-box", "banner-ad")}">{inside}</{t}>'

    def notice(self) -> str:
        inside = self.pick(self.prose(OTHER, 5, 40), f"<p>{self.prose(OTHER, 5, 60)}</p>", f"<h2>{self.words(0, 4, OTHER)}</h2><p>{self.prose(OTHER, 5, 30)}</p>")
        return f'<{(t := self.pick("div", "div", "section", "dialog"))} {self.pick("class", "id")}="{self.pick("cookie-notice", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter-popup")}">{inside}</{t}>'

    def sidebar(self) -> str:
        inside = "".join(self.pick(f"<h3>{self.words(0, 3, OTHER)}</h3>{self.links(OTHER, 4)}", f"<div>{self.prose(OTHER, 4, 50)}</div>", f"<p>{self.prose(OTHER, 4, 60)}</p>", self.ad()) for _ in range(self.r.randint(1, 3)))
        return self.pick(f"<aside>{inside}</aside>", f"<aside class='sidebar'>{inside}</aside>", f'<div class="{self.pick("sidebar", "widget", "related-posts", "recommended", "trending", "side")}">{inside}</div>', f'<div id="sidebar">{inside}</div>')

    def form(self) -> str:
        inside = f"<label>{self.words(0, 3, OTHER)}</label><input name=q>" + self.maybe(0.6, f"<p>{self.prose(OTHER, 3, 30)}</p>") + "<button>Go</button>"
        return self.pick(f"<form>{inside}</form>", f"<form>{inside}</form>", f'<div class="{self.pick("newsletter", "subscribe", "search-form", "login", "contact-form")}">{inside}</div>')

    def share(self) -> str:
        return f'<div class="{self.pick("share", "social-links", "tags", "sharing")}">{self.links(OTHER, 3)}</div>'

    def comments(self) -> str:
        def one() -> str:
            body = self.pick(f"<p>{self.prose(OTHER, 3, 80)}</p>", self.prose(OTHER, 3, 60), f"<b>{self.words(0, 1, OTHER)}</b><p>{self.prose(OTHER, 5, 50)}</p>")
            return self.pick(f'<div class="comment">{body}</div>', f"<li>{body}</li>", f"<article>{body}</article>", f"<p>{self.prose(OTHER, 4, 60)}</p>", f"<div>{body}</div>")

        inside = self.maybe(0.5, f"<h2>{self.words(0, 3, OTHER)}</h2>") + "".join(one() for _ in range(self.r.randint(1, 5))) + self.maybe(0.3, self.form())
        return f'<{(t := self.pick("div", "section", "section", "ol"))} {self.pick("class", "id")}="{self.pick("comments", "comment-list", "discussion", "reader-comments", "responses replies", "comments-area")}">{inside}</{t}>'

    def article(self) -> str:
        title = f"<h1>{self.words(2, 10, CONTENT)}</h1>"
        body = []
        if not self.r.randrange(6):  # many short paragraphs
            body = [f"<p>{self.words(0, 3, CONTENT)}{self.pick('.', '.', ' |', '')}</p>" for _ in range(self.r.randint(5, 60))]
        for _ in range(self.r.choice([1, 3, 6, 12, 30, 60]) if not self.r.randrange(4) else self.r.randint(1, 12)):
            body.append(
                self._weighed(
                    [
                        f"<p>{self.prose(CONTENT, 4, 120)}</p>",
                        f"<p>{self.words(0, 2, CONTENT)}.</p>",
                        f"<p><b>{self.prose(CONTENT, 3, 30)}<br>",
                        f"<h2>{self.words(1, 6, CONTENT)}</h2>",
                        f"<ul>{''.join(f'<li>{self.prose(CONTENT, 2, 25)}</li>' for _ in range(self.r.randint(1, 4)))}</ul>",
                        f"<blockquote><p>{self.prose(CONTENT, 5, 50)}</p></blockquote>",
                        f"<table><tr><td>{self.words(0, 4, CONTENT)}</td><td>{self.words(0, 4, CONTENT)}</td></tr></table>",
                        f"<figure><img src=x><figcaption>{self.words(2, 10, CONTENT)}</figcaption></figure>",
                        f"<pre>{self.words(3, 30, CONTENT)}</pre>",
                        f"<div>{self.prose(CONTENT, 5, 90)}</div>",
                        f"<section><h2>{self.words(1, 4, CONTENT)}</h2><p>{self.prose(CONTENT, 6, 90)}</p></section>",
                        f'<div class="text"><p>{self.prose(CONTENT, 6, 90)}</p></div>',
                        self.ad(),
                        self.share(),
                        self.form(),
                        f"<p>{self.words(2, 20, CONTENT)} <span>{self.words(1, 4, CONTENT)}</span></p>",
                    ],
                    [12, 2, 2, 2, 1.5, 1, 0.7, 0.5, 0.5, 1, 1, 0.7, 0.8, 0.4, 0.3, 1],
                )
            )
        inside = self.pick(title, title, f"<header>{title}</header>", "") + "".join(body)
        if not self.r.randrange(5):
            inside += f"<p>{self.prose(CONTENT, 3, 10)}"  # its end tag is missing
        inside += self.maybe(0.15, self.sidebar()) + self.maybe(0.2, self.comments())
        return self._weighed(
            [
                f"<article>{inside}</article>",
                f"<main>{inside}</main>",
                f"<main><article>{inside}</article></main>",
                f'<div class="{self.pick("content", "post-content", "entry-content", "article-body", "story")}">{inside}</div>',
                f'<div id="{self.pick("content", "main", "article")}">{inside}</div>',
                f"<div>{inside}</div>",
                inside,
            ],
            [5, 2, 2, 2, 2, 1, 1],
        )

    def page(self) -> str:
        before = self.maybe(0.3, self.notice()) + self.maybe(0.5, self.header()) + self.maybe(0.7, self.nav()) + self.maybe(0.4, self.ad()) + self.maybe(0.15, self.sidebar()) + self.maybe(0.15, self.form())
        after = self.maybe(0.15, self.share()) + self.maybe(0.4, self.comments()) + self.maybe(0.35, self.sidebar()) + self.maybe(0.25, self.ad()) + self.maybe(0.2, self.form()) + self.maybe(0.8, self.footer()) + self.maybe(0.2, self.notice())
        article = self.article()
        middle = self.pick(article, article, f'<div class="{self.pick("container", "wrapper", "page", "layout")}">{article}{self.maybe(0.5, self.sidebar())}</div>', f"<div>{self.maybe(0.3, self.sidebar())}{article}</div>")
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5, OTHER)}</title><style>p{{}}</style></head><body>{before}{middle}{after}{self.maybe(0.9, '</body></html>')}"


def labelled(seed: int, half: int | None = None) -> tuple[Page, list[int], str]:
    """A page, its nodes' labels and its HTML."""
    html = _Writer(seed, half).page()
    page = Page(html)
    labels = [0] * len(page.parent)
    for k in range(len(labels) - 1, -1, -1):
        if page.text[k] is not None:
            labels[k] = int(page.text[k].startswith(CONTENT))
        if labels[k] and k:
            labels[page.parent[k]] = 1
    return page, labels, html


def train(pages: int = 600, rounds: int = 120, penalty: float = 0.5, rate: float = 0.15, half: int | None = None) -> dict[str, float]:
    data = [labelled(seed, half)[:2] for seed in range(pages)]
    weights: dict[str, float] = {}
    m: dict[str, float] = {}
    v: dict[str, float] = {}
    for step in range(1, rounds + 1):
        slope: dict[str, float] = {f: -penalty * w for f, w in weights.items()}
        edges = edge_potentials(weights)
        for page, labels in data:
            potentials = [edges[k] for k in page.kind]
            total, up = messages(page.parent, node_odds(page, weights), potentials)
            for k, (o, y) in enumerate(zip(total, labels, strict=True)):
                off = y - 1 / (1 + exp(-max(-50.0, min(50.0, o))))
                for f in page.features[k]:
                    slope[f] = slope.get(f, 0.0) + off
                if k:
                    a, b, c, d = potentials[k]
                    above = max(-50.0, min(50.0, total[page.parent[k]] - up[k]))
                    e = exp(above)
                    # The child's own odds: its marginal without the message from above.
                    own = exp(max(-50.0, min(50.0, o - _down(potentials[k], e))))
                    cells = [exp(a), exp(b) * own, exp(c) * e, exp(d) * e * own]
                    z = sum(cells)
                    for x, p in zip(("00", "01", "10", "11"), cells, strict=True):
                        f = f"{page.kind[k]}:{x}"
                        seen = f"{labels[page.parent[k]]}{y}" == x
                        slope[f] = slope.get(f, 0.0) + seen - p / z
        for f, g in slope.items():
            m[f] = 0.9 * m.get(f, 0.0) + 0.1 * g
            v[f] = 0.99 * v.get(f, 0.0) + 0.01 * g * g
            weights[f] = weights.get(f, 0.0) + rate * (m[f] / (1 - 0.9**step)) / ((v[f] / (1 - 0.99**step)) ** 0.5 + 1e-8)
    return {f: round(w, 4) for f, w in sorted(weights.items())}


def _down(potentials: tuple[float, float, float, float], e: float) -> float:
    from math import log

    a, b, c, d = potentials
    return log((exp(b) + exp(d) * e) / (exp(a) + exp(c) * e))


def accuracy(weights: dict[str, float], seeds, half: int | None = None) -> float:
    """The share of text blocks of other labelled pages that get their label."""
    right = n = 0
    edges = edge_potentials(weights)
    for seed in seeds:
        page, labels, _ = labelled(seed, half)
        total, _ = messages(page.parent, node_odds(page, weights), [edges[k] for k in page.kind])
        for text, o, y in zip(page.text, total, labels, strict=True):
            if text is not None:
                right += (o > 0) == bool(y)
                n += 1
    return right / n


if __name__ == "__main__":
    found = train()
    print("held-out accuracy", accuracy(found, range(10_000, 10_300)))
    lines = "".join(f'    "{f}": {w},\n' for f, w in found.items())
    Path(__file__).with_name("html_weights.py").write_text(f'"""Weights of html_extract, written by html_training."""\n\nWEIGHTS: dict[str, float] = {{\n{lines}}}\n')
