"""Labelled pages for fitting the main-text model: layout families whose main blocks are known as they are built.

``named`` pages have telling class names, ``opaque`` ones names without a meaning, so that only structure tells; ``divs`` use no semantic
elements, ``table`` pages are laid out by table cells, and ``portal`` pages put teasers and link lists around a short article.
"""

from __future__ import annotations

import numpy as np

FAMILIES = ["named", "opaque", "divs", "table", "portal"]
_VOWELS, _CONSONANTS = "aeiouéäó", "bcdfghlmnprstvz"
#: Class names that pages give to their parts.
_MAIN = ["content", "post", "entry-content", "article-body", "story", "main-content", "post-text", "c-article", "page-body", "blog-post", "prose", "article", "main", "entry", "text", "detail", "news-body", "body-copy", "column-main", "paragraphs", "headline-block"]
_WRAP = ["wrapper", "container", "row", "col", "page", "site", "layout", "inner", "l-grid", "outer"]
_BOILER = {
    "ad": ["ad", "ads", "advert", "ad-banner", "sponsored", "promo-box", "advertisement", "sponsor", "promo", "banner", "outbrain"],
    "side": ["sidebar", "side", "widget", "related", "popular-posts", "trending", "recommended", "more-links", "archive", "side-links"],
    "note": ["cookie-notice", "notice", "consent", "gdpr-banner", "popup", "alert", "modal", "overlay", "legal-notice"],
    "talk": ["comments", "comment-list", "reader-comments", "discussion", "replies", "responses", "disqus", "thread", "feedback"],
    "form": ["newsletter", "login-form", "search-form", "subscribe", "signup", "contact-form", "search-box", "toolbar"],
    "share": ["share", "social-links", "tags", "breadcrumbs", "meta-links", "pagination", "pager", "social", "breadcrumb", "skip-links"],
}
_MENU = ["menu", "nav", "navbar", "top-menu", "navigation", "main-menu"]
_HEAD = ["site-header", "masthead", "header", "top-bar"]
_FOOT = ["footer", "site-footer", "copyright", "foot", "bottom"]

#: Share of lists of siblings that are long (65 to 184).
LONG = 0.03


class _Page:
    def __init__(self, rng: np.random.Generator, family: str):
        self.rng, self.family, self.main = rng, family, set()

    def pick(self, values: list[str]) -> str:
        return values[self.rng.integers(len(values))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def many(self, low: int, high: int) -> int:
        """A number of siblings: now and then a long page, as flat articles, link lists and threads may have."""
        return int(self.rng.integers(65, 185)) if self.chance(LONG) else int(self.rng.integers(low, high))

    def word(self) -> str:
        return "".join(self.pick([*_CONSONANTS]) + self.pick([*_VOWELS]) for _ in range(self.rng.integers(1, 4)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        words = [self.word() for _ in range(self.rng.integers(low, high))]
        return " ".join(w + "," * self.chance(0.08) for w in words).strip(",").capitalize() + "."

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.integers(low, high)))

    def attrs(self, names: list[str]) -> str:
        if self.family == "opaque":
            name = self.pick(["c", "x", "css-", "b_", "u"]) + str(self.rng.integers(100)) + self.pick([*_CONSONANTS])
            return self.pick([f' class="{name}"', f' id="{name}"', ""])
        name = self.pick(names)
        return self.pick([f' class="{name}"', f' id="{name}"', f" class='{self.pick(_WRAP)} {name}'"])

    def links(self, n: int, tag: str = "li") -> str:
        rows = "".join(f'<{tag}><a href="/{self.word()}">{" ".join(self.word() for _ in range(self.rng.integers(1, 4))).title()}</a></{tag}>' for _ in range(n))
        return f"<ul>{rows}</ul>" if tag == "li" else rows

    def keep(self, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return text

    def article(self) -> str:
        rng, out = self.rng, []
        count = int(rng.integers(65, 185) if self.chance(LONG) else rng.choice([0, 1, 1, 2, 3, 5, 8, 14]))
        if not count or self.chance(0.85):
            title = self.keep(self.sentence(1, 12)[: int(rng.integers(2, 80))])
            out.append(f"<h1>{title}</h1>")
            if self.chance(0.4):
                out.append(f"<p><b>{self.keep(title + self.word())}<br>")
        for _ in range(count):
            kind = rng.random()
            if kind < 0.72:
                text = self.keep(self.prose() if self.chance(0.85) else self.sentence(1, 6))
                head, tail = ("<b>", "<br>") if self.chance(0.1) else ("", "</p>" if self.chance(0.8) else "")
                out.append(f"<p>{head}{text}{tail}")
            elif kind < 0.8:
                out.append(f"<h{rng.integers(2, 4)}>{self.keep(self.sentence(2, 6))}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.keep(self.sentence(3, 14))}</li>" for _ in range(rng.integers(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.keep(self.prose(1, 3))}</blockquote>")
            elif kind < 0.94:
                a, b, c = self.prose(1, 2), self.word(), self.sentence()
                self.keep(f"{a} {b} {c}")
                out.append(f'<p>{a} <a href="/{b}">{b}</a> {c}</p>')
            elif kind < 0.97:
                out.append(self.boiler(self.pick(["ad", "share"])))
            else:
                out.append("<table>" + "".join(f"<tr><td>{self.keep(self.sentence(1, 4))}</td><td>{self.keep(self.sentence(1, 4))}</td></tr>" for _ in range(2)) + "</table>")
        return "".join(out)

    def boiler(self, kind: str) -> str:
        rng, tag = self.rng, "div" if self.family == "divs" else self.pick(["div", "div", "section", "aside"])
        if self.family == "opaque" and kind in ("ad", "note", "side"):
            tag = "aside"  # prose in nameless blocks beside a nameless article could not be told from it
        if kind == "form":
            inner = f'<form action="/x"><p>{self.sentence()}</p><label>{self.word()}</label><input name="a"><button>{self.word()}</button></form>'
        elif kind == "share":
            inner = self.links(self.many(2, 6))
        elif kind == "talk":
            inner = f"<h3>{self.sentence(1, 3)}</h3>" + "".join(f'<div{self.attrs(["comment", "comment-body", "reply", "c"])}><p>{self.word().title()}</p><p>{self.prose(1, 3)}</p></div>' for _ in range(self.many(1, 6)))
        elif kind == "side":
            inner = f"<h3>{self.sentence(1, 4)}</h3>" + (self.links(self.many(2, 8)) if self.chance(0.6) else f"<p>{self.prose(1, 3)}</p>")
        else:
            inner = self.prose(1, 3) if self.chance(0.6) else f"<p>{self.prose(1, 2)}</p>" + (f'<a href="/x">{self.word()}</a>' if self.chance(0.5) else "")
        return f"<{tag}{self.attrs(_BOILER[kind])}>{inner}</{tag}>"

    def element(self, tag: str, names: list[str], inner: str) -> str:
        """A semantic element, or a named one where the family has none."""
        plain = self.family == "divs" or (self.family == "named" and self.chance(0.4))
        return f"<div{self.attrs(names)}>{inner}</div>" if plain else f"<{tag}{self.attrs(names) if self.chance(0.4) else ''}>{inner}</{tag}>"

    def menu(self) -> str:
        return self.element("nav", _MENU, self.links(self.many(2, 9), "li" if self.chance(0.7) else "span"))

    def footer(self) -> str:
        foot = f"&copy; {self.word()} &middot; {self.prose(1, 2)}" if self.chance(0.6) else f"<p>&copy; {self.sentence()}</p>{self.links(int(self.rng.integers(1, 5)))}"
        return self.element("footer", _FOOT, foot)

    def teasers(self) -> str:
        """Cards that lead elsewhere: a linked title, with or without a line of text."""
        cards = "".join(f'<div{self.attrs(["card", "teaser", "item", "tile"])}><h3><a href="/{self.word()}">{self.sentence(2, 7)}</a></h3>{f"<p>{self.sentence()}</p>" if self.chance(0.5) else ""}</div>' for _ in range(self.many(2, 7)))
        return f"<div{self.attrs(['teasers', 'cards', 'grid', 'latest', 'more-news'])}>{cards}</div>"

    def around(self, share: float) -> tuple[list[str], list[str]]:
        """Boilerplate before and after the main text."""
        top = [self.boiler(k) for k in ["note", "ad", "share", "form"] if self.chance(share)]
        bottom = [self.boiler(k) for k in ["talk", "side", "share", "form", "ad", "note", "talk"] if self.chance(share)]
        return top, bottom

    def wrapped(self) -> str:
        """The article in the element that a page of the family gives it."""
        body = self.article()
        if self.family == "divs":
            return f"<div{self.attrs(_MAIN)}>{body}</div>"
        if self.family == "opaque":
            return self.pick([f"<article>{body}</article>", f"<main>{body}</main>", f"<div{self.attrs(_MAIN)}>{body}</div>"])
        style = self.rng.random()
        if style < 0.5:
            return f"<article{self.attrs(_MAIN) if self.chance(0.4) else ''}>{body}</article>"
        if style < 0.7:
            return f"<main>{body}</main>" if self.chance(0.5) else f'<div role="main">{body}</div>'
        return f"<div{self.attrs(_MAIN)}>{body}</div>" if style < 0.95 else body

    def build(self) -> str:
        style = "<style>a{color:red}</style>" if self.chance(0.5) else ""
        script = f'<script>if (1 < 2) {{ show("<p>{self.word()}</p>"); }}</script>' if self.chance(0.5) else ""
        head = f"<!DOCTYPE html><html><head><title>{self.sentence()}</title>{style}{script}</head><body>"
        top, bottom = self.around({"named": 0.35, "opaque": 0.25, "divs": 0.35, "table": 0.2, "portal": 0.3}[self.family])
        if self.chance(0.8):
            menu = self.menu()
            top.insert(0, menu if self.chance(0.5) else self.element("header", _HEAD, f"<p>{self.sentence(1, 4)}</p>{menu}"))
        if self.chance(0.85):
            bottom.append(self.footer())
        if self.chance(0.3):
            top.append(f"<!-- {self.word()} -->")
        body = self.wrapped()
        if self.family == "portal":
            top, bottom = [*top, self.teasers()], [self.teasers(), *bottom]
        elif self.family == "table":
            side = f"<td{self.attrs(_MENU)}>{self.links(self.many(2, 9))}</td>"
            right = f"<td{self.attrs(_BOILER['side'])}>{self.boiler('side')}</td>" if self.chance(0.5) else ""
            body = f"<table><tr>{side}<td{self.attrs(_MAIN)}>{body}</td>{right}</tr></table>"
        elif self.chance(0.3):
            body = f"<div{self.attrs(_WRAP)}>{body}{self.boiler('side') if self.chance(0.5) else ''}</div>"
        return head + "".join(top) + body + "".join(bottom) + "</body></html>" * self.chance(0.95)


def labelled_page(rng: np.random.Generator, family: str = "named") -> tuple[str, set[str]]:
    """(html, texts of the main blocks) of a page of a layout family."""
    page = _Page(rng, family)
    html = page.build()
    return html, page.main
