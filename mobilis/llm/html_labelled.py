"""Labelled pages to train the extraction model on.

Pages are put together from common layouts: where menus, notices, adverts,
forms, comments and side columns stand, and how sites name them. Every part is
written as main or not when it is made. The words are random syllables, so that
a model can learn from structure and shape only.
"""

from __future__ import annotations

import random

#: Names that sites use in class and id attributes, by the kind of part.
NAMES = {
    "main": "post-content|entry-content|article-body|story|post|entry|article|content|main-content|body-text|page-content|text".split("|"),
    "nav": "nav|menu|navbar|navigation|main-menu|breadcrumbs|breadcrumb|topnav|site-nav|tabs|pagination|pager".split("|"),
    "header": "header|site-header|masthead|top-bar|branding|logo|banner|toolbar".split("|"),
    "footer": "footer|site-footer|copyright|legal|colophon|bottom|credits|imprint".split("|"),
    "side": "sidebar|side|widget|widgets|related|recommended|trending|popular|more-stories|archive|tags|tag-cloud|rail".split("|"),
    "ad": "ad|ads|advert|advertisement|sponsored|promo|promotion|ad-slot|adsense|sponsor|commercial|teaser".split("|"),
    "notice": "cookie-notice|cookies|cookie-banner|consent|gdpr|notice|alert|popup|modal|overlay|paywall|disclaimer|privacy".split("|"),
    "form": "newsletter|subscribe|signup|search|search-form|login|contact-form|subscription".split("|"),
    "comments": "comments|comment|comment-list|discussion|responses|replies|reader-comments|comment-body|disqus|reply".split("|"),
    "share": "share|social|sharing|share-buttons|follow|social-links".split("|"),
}
SYLLABLES = "ta re mi so lan der qui ves on pra el ut ci nor bas tem lo fi gan chu sté ño üb kal zim wo ny pet".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []

    def words(self, low: int, high: int, end: str = "") -> str:
        rng = self.rng
        out = []
        for k in range(rng.randint(low, high)):
            word = "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
            out.append(word.capitalize() if not k or rng.random() < 0.05 else word)
            if rng.random() < 0.08:
                out[-1] += rng.choice(",,,;:.")
        return " ".join(out) + end

    def text(self, tag: str, value: str, main: bool, link: bool = False) -> None:
        self.html.append(f"<{tag}>" + (f'<a href="/x">{value}</a>' if link else value) + f"</{tag}>")
        self.labels.append(main)

    def open(self, tag: str, kind: str | None = None, named: float = 1.0) -> str:
        name = f' {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(NAMES[kind])}"' if kind and self.rng.random() < named else ""
        self.html.append(f"<{tag}{name}>")
        return f"</{tag}>"

    def part(self, tag: str, kind: str, fill, named: float = 1.0) -> None:
        end = self.open(tag, kind, named)
        fill()
        self.html.append(end)

    def links(self, low: int = 3, high: int = 8) -> None:
        self.html.append("<ul>")
        for _ in range(self.rng.randint(low, high)):
            self.text("li", self.words(1, 3), False, link=True)
        self.html.append("</ul>")

    def small(self, low: int = 2, high: int = 14) -> None:
        for _ in range(self.rng.randint(1, 2)):
            self.text(self.rng.choice(["p", "p", "div", "span"]) if self.rng.random() < 0.9 else "h3", self.words(low, high, self.rng.choice(["", "."])), False)
            if self.html[-1].startswith("<span"):
                self.html.append("<hr>")

    def prose(self) -> None:
        """Text of other parts that looks like an article's."""
        for _ in range(self.rng.randint(1, 3)):
            self.text("p", self.words(5, 60, "."), False)

    def form(self) -> None:
        self.text("label", self.words(1, 4), False)
        self.html.append('<input type="text"><hr>')
        if self.rng.random() < 0.5:
            self.text("button", self.words(1, 2), False)
        if self.rng.random() < 0.4:
            self.text("p", self.words(4, 20, "."), False)

    def extra(self) -> None:
        """Something that does not belong to the article, inside or beside it."""
        kind = self.rng.choice(["ad", "ad", "share", "form", "side", "notice"])
        if kind == "form":
            self.part("form", "form", self.form, 0.6)
        else:
            self.part("aside" if kind == "side" else "div", kind, self.links if kind in ("side", "share") else self.rng.choice([self.small, self.prose]))

    def comments(self) -> None:
        if self.rng.random() < 0.7:
            self.text("h3", self.words(1, 3), False)
        for _ in range(self.rng.randint(1, 4)):
            end = self.open(self.rng.choice(["div", "li", "article"]), "comments", 0.7)
            self.text("p", self.words(2, 50, "."), False)
            self.html.append(end)

    def body(self) -> None:
        rng = self.rng
        if rng.random() < 0.8:
            self.text(rng.choice(["h1", "h1", "h2"]), self.words(3, 12), True)
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.70:
                self.text("p", self.words(1, 9, ".") if rng.random() < 0.3 else self.words(10, 90, "."), True)
            elif kind < 0.76:
                self.text("h2", self.words(2, 7), True)
            elif kind < 0.82:
                self.html.append("<ul>" if rng.random() < 0.6 else "<ol>")
                for _ in range(rng.randint(2, 5)):
                    self.text("li", self.words(2, 15), True)
                self.html.append("</ul>" if "<ul>" in self.html[-6:] else "</ol>")
            elif kind < 0.86:
                self.html.append("<blockquote>")
                self.text("p", self.words(6, 30, "."), True)
                self.html.append("</blockquote>")
            elif kind < 0.89:
                self.html.append("<table><tr>")
                for _ in range(rng.randint(2, 6)):
                    self.text("td", self.words(1, 3), True)
                self.html.append("</tr></table>")
            elif kind < 0.92:
                self.text("pre", self.words(4, 20), True)
            elif kind < 0.95:
                self.html.append("<figure><img>")
                self.text("figcaption", self.words(3, 12, "."), True)
                self.html.append("</figure>")
            else:
                self.extra()

    def build(self) -> tuple[str, list[bool]]:
        rng = self.rng
        if rng.random() < 0.3:
            self.part("div", "notice", rng.choice([self.small, self.prose]))
        if rng.random() < 0.5:
            self.part(rng.choice(["header", "header", "div"]), "header", self.small, 0.8 if self.html else 1.0)
        if rng.random() < 0.8:
            tag = rng.choice(["nav", "nav", "div"])
            self.part(tag, "nav", self.links, 0.5 if tag == "nav" else 1.0)
        if rng.random() < 0.35:
            self.part("div", "ad", rng.choice([self.small, self.prose]))
        if rng.random() < 0.25:
            self.part("aside", "side", rng.choice([self.links, self.prose]), 0.6)
        ends = [self.open("main", None)] if rng.random() < 0.4 else []
        if rng.random() < 0.65:
            ends.append(self.open("article", "main", 0.5))
        else:
            ends.append(self.open(rng.choice(["div", "section"]), "main"))
        self.body()
        inside = rng.random() < 0.4
        tail = [lambda: self.part(rng.choice(["section", "div", "div"]), "comments", self.comments)] * (rng.random() < 0.45)
        tail += [self.extra] * (rng.random() < 0.4)
        rng.shuffle(tail)
        if not inside:
            self.html += reversed(ends)
        for f in tail:
            f()
        if inside:
            self.html += reversed(ends)
        if rng.random() < 0.3:
            self.part(rng.choice(["aside", "div"]), "side", rng.choice([self.links, self.prose]))
        if rng.random() < 0.8:
            tag = rng.choice(["footer", "footer", "div"])
            self.part(tag, "footer", rng.choice([self.small, self.prose, self.links]), 0.4 if tag == "footer" else 1.0)
        return "<html><body>" + "".join(self.html) + "</body></html>", self.labels


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[bool]]]:
    """Pages with, for each leaf block in page order, whether it belongs to the main text."""
    rng = random.Random(seed)
    return [_Page(rng).build() for _ in range(count)]
