"""Labelled pages for the extraction model: layouts built from a seed, each leaf block with its label.

The words are invented, so only structure, class names and the shape of texts can
be learned.  Layouts mix semantic elements, classed divisions and tables, with
boilerplate around and inside of the article.
"""

from __future__ import annotations

import random

CONTAINERS = ("article", "main", "main>article", "div.content", "div.post-body", "div.entry-content", "section.article", "div#main-content", "div.story", "div.article-text", "article>div.body", "main>div.content")
#: (wrapper, how its inside is built)
BOILERPLATE = (
    ("nav", "menu"), ("div.menu", "menu"), ("div.navigation", "menu"), ("nav.breadcrumb", "menu"), ("header", "short"), ("header", "menu"), ("div.header", "short"), ("div#top-bar", "short"),
    ("footer", "short"), ("div.footer", "short"), ("footer", "text"), ("footer", "menu"), ("aside", "text"), ("aside", "menu"), ("div.sidebar", "text"), ("div.sidebar", "menu"), ("div.widget", "text"),
    ("div.ad", "text"), ("div.ads", "text"), ("div.advert", "text"), ("div.advertisement", "long"), ("div.sponsored", "text"), ("div.banner", "text"), ("div.promo", "text"), ("aside.ad", "text"),
    ("div.cookie-notice", "text"), ("div.cookie-banner", "text"), ("div.notice", "text"), ("div.alert", "text"), ("div.gdpr", "text"), ("div.consent", "text"), ("p.notice", "plain"),
    ("form", "form"), ("div.newsletter", "form"), ("div.subscribe", "form"), ("div.search", "form"), ("div.login", "form"), ("form.comment-form", "form"),
    ("div.comments", "comments"), ("section.comments", "comments"), ("section#comments", "comments"), ("ol.commentlist", "comments"), ("div.comment", "long"), ("div.discussion", "comments"), ("div.replies", "comments"),
    ("div.related", "menu"), ("div.share", "menu"), ("div.social", "menu"), ("div.tags", "menu"), ("div.pagination", "menu"), ("div.copyright", "short"), ("p.copyright", "plain"), ("div.disclaimer", "text"), ("div.popup", "text"), ("div.modal", "text"),
)


class _Builder:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        made = ["".join(r.choice("aeiou") + r.choice("bcdlmnrst") for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return " ".join(made).capitalize() + r.choice((".", ".", "", "!", ".&nbsp;" if r.random() < 0.1 else "."))

    def wrapped(self, path: str, inside) -> None:
        tags = []
        for one in path.split(">"):
            tag, _, cls = one.partition(".")
            name = f' class="{cls}"' if cls else ""
            if "#" in tag:
                tag, _, ident = tag.partition("#")
                name = f' id="{ident}"'
            tags.append(tag)
            self.out.append(f"<{tag}{name}>")
        inside()
        self.out += [f"</{t}>" for t in reversed(tags)]

    def mark(self, label: int, tag: str, text: str, plain: bool = False) -> None:
        """A leaf block; its label travels as a character that the trainer strips."""
        text = f"{chr(0xE000 + label)}{text}"
        self.out.append(text if plain else f"<{tag}>{text}</{tag}>")

    def boilerplate(self, wrapper: str, kind: str) -> None:
        r = self.r

        def inside():
            if kind == "menu":
                self.out.append("<ul>")
                for _ in range(r.randint(2, 7)):
                    self.mark(0, "li", f'<a href="/x">{self.words(1, 3)}</a>')
                self.out.append("</ul>")
            elif kind == "form":
                self.mark(0, "label", self.words(1, 4), r.random() < 0.5)
                self.out.append('<input type="text">')
                if r.random() < 0.5:
                    self.mark(0, "p", self.words(2, 20))
                self.mark(0, "button", self.words(1, 2))
            elif kind == "comments":
                for _ in range(r.randint(1, 5)):
                    tag = r.choice(("p", "li", "div"))
                    self.mark(0, tag, self.words(2, 60))
            elif kind == "plain":
                self.mark(0, "", self.words(2, 20), True)
            else:
                lo, hi = {"short": (1, 8), "text": (3, 30), "long": (10, 80)}[kind]
                if r.random() < 0.4:
                    self.mark(0, "", self.words(lo, hi), True)
                else:
                    for _ in range(r.randint(1, 3)):
                        self.mark(0, r.choice(("p", "p", "div", "h3", "span")), self.words(lo, hi))

        self.wrapped(wrapper, inside)

    def article(self) -> None:
        r = self.r

        def inside():
            if r.random() < 0.8:
                if r.random() < 0.15:
                    self.out.append("<header>")
                    self.mark(1, "h1", self.words(2, 12))
                    self.out.append("</header>")
                else:
                    self.mark(1, r.choice(("h1", "h1", "h2")), self.words(1, 12))
            for _ in range(r.randint(1, 14)):
                x = r.random()
                if x < 0.7:
                    self.mark(1, "p", self.words(*r.choice(((1, 3), (5, 30), (20, 90)))))
                elif x < 0.76:
                    self.out.append("<p><b>" + chr(0xE001) + self.words(3, 40) + "<br>")
                elif x < 0.82:
                    self.mark(1, r.choice(("h2", "h3", "blockquote", "pre", "div", "figcaption")), self.words(1, 25))
                elif x < 0.88:
                    self.out.append("<ul>")
                    for _ in range(r.randint(1, 4)):
                        self.mark(1, "li", self.words(1, 15))
                    self.out.append("</ul>")
                elif x < 0.92:
                    self.mark(1, "p", f'{self.words(2, 10)} <a href="/y">{self.words(1, 4)}</a> {self.words(1, 20)}')
                elif x < 0.96:
                    self.out.append("<table><tr>")
                    for _ in range(r.randint(1, 4)):
                        self.mark(1, "td", self.words(1, 6))
                    self.out.append("</tr></table>")
                else:
                    self.boilerplate(*r.choice(BOILERPLATE))

        self.wrapped(r.choice(CONTAINERS), inside)

    def page(self) -> str:
        r = self.r
        self.out = ["<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>"]
        outer = r.random() < 0.3
        if outer:
            self.out.append(f'<div class="{r.choice(("wrapper", "page", "container", "site"))}">')
        for _ in range(r.randint(1, 5)):
            self.boilerplate(*r.choice(BOILERPLATE))
        self.article()
        for _ in range(r.randint(1, 5)):
            self.boilerplate(*r.choice(BOILERPLATE))
        if outer:
            self.out.append("</div>")
        return "".join(self.out) + ("" if r.random() < 0.1 else "</body></html>")


def labelled_pages(count: int, seed: int = 0) -> list[str]:
    """Pages whose leaf blocks start with U+E000 (boilerplate) or U+E001 (article)."""
    return [_Builder(seed * 1_000_003 + i).page() for i in range(count)]
