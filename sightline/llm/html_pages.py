"""Labelled pages to train the extraction model on: invented articles in many layouts, every block marked with its state.

States: O (outside: wraps the article or other parts), C (content), B (boilerplate).
"""

from __future__ import annotations

import random

#: Naming words of boilerplate and of content, as sites use them.
BOILERPLATE = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination toc links tabs".split(),
    "header": "header masthead banner site-header topbar branding logo page-header".split(),
    "footer": "footer site-footer bottom copyright colophon legal footnotes".split(),
    "sidebar": "sidebar side aside widget widgets rail related recommended trending popular secondary".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message disclaimer warning banner-notice".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adsbygoogle banner-ad commercial".split(),
    "form": "form newsletter subscribe search login signup register contact-form respond".split(),
    "comments": "comments comment discussion replies reply responses disqus feedback reader-comments comment-list".split(),
    "share": "share social sharing follow buttons toolbar tags meta byline author-box".split(),
}
CONTENT = "article content post entry story main body text post-content entry-content article-body page-content prose single hentry".split()
WRAPPERS = "wrapper container page site layout row grid inner outer main-wrapper columns app root wrap".split()
_SYLLABLES = "ba ne ri to lu ka mo si der el an ing tion ver en ou re ta le ci ón que".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.odd = self.r.random() < 0.15  # pages whose words carry marks
        self.terse = self.r.random() < 0.25  # articles of short paragraphs

    def words(self, n: int) -> str:
        r, out = self.r, []
        for _ in range(n):
            w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
            w += r.choice(("", "", "", "", ",", "")) + (r.choice(("###", "***", "%%%", "&amp;&amp;")) if self.odd else "")
            out.append(w)
        return " ".join(out)

    def sentence(self, n: int | None = None) -> str:
        s = self.words(n or self.r.choice((3, 6, 9, 14, 20)))
        return s[0].upper() + s[1:] + self.r.choice((".", ".", ".", "!", "?", ""))

    def paragraph(self) -> str:
        """Prose of an article."""
        return self.sentence(self.r.randint(1, 5)) if self.terse and self.r.random() < 0.8 else self.prose()

    def prose(self) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 13))))
        if self.r.random() < 0.05:
            text = " ".join([self.words(1)] * self.r.randint(10, 60))  # poor prose is content all the same
        if self.r.random() < 0.2:
            text += f' <a href="/x">{self.words(2)}</a> {self.sentence()}'
        if self.r.random() < 0.2:
            text = f"<b>{self.words(2)}</b> {text}"
        return text.replace(". ", ".<br>", 1) if self.r.random() < 0.05 else text

    def tag(self, tag: str, state: str, inner: str, names: str = "") -> str:
        named = f' {self.r.choice(("class", "class", "id"))}="{names}"' if names else ""
        return f'<{tag}{named} data-y="{state}">{inner}</{tag}>'

    def name(self, kind: str) -> str:
        own = self.r.choice(BOILERPLATE[kind])
        return own if self.r.random() < 0.7 else f"{self.r.choice(('site', 'box', 'block', 'c', 'col', 'js', 'module'))}-{own}"

    def links(self) -> str:
        return self.tag("ul", "B", "".join(self.tag("li", "B", f'<a href="/{i}">{self.words(self.r.randint(1, 4))}</a>') for i in range(self.r.randint(2, 9))))

    def boilerplate(self, kind: str) -> str:
        r = self.r
        semantic = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag = semantic if r.random() < 0.6 else r.choice(("div", "div", "section", "aside"))
        names = self.name(kind) if tag == "div" or r.random() < 0.5 or kind == "comments" else ""
        p = lambda text: self.tag(r.choice(("p", "p", "div", "span")), "B", text)
        if kind == "menu":
            inner = self.links() if r.random() < 0.8 else " | ".join(f'<a href="#">{self.words(1)}</a>' for _ in range(5))
        elif kind == "header":
            inner = r.choice((self.tag("h1", "B", self.words(2)), self.tag("div", "B", self.words(2), "logo"), p(self.sentence(6)), self.words(4))) + (self.boilerplate("menu") if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = r.choice((f"&copy; 2024 {self.words(3)} &middot; {self.sentence()}", p("Copyright " + self.sentence()), self.links() + p(self.sentence()), p(self.prose())))
        elif kind == "sidebar":
            inner = self.tag("h3", "B", self.words(2)) + r.choice((self.links(), p(self.prose()), p(self.sentence()) + self.links(), p(self.prose()) + p(self.prose())))
        elif kind == "notice":
            inner = r.choice((self.sentence(), p(self.prose()), p(self.sentence(14)) + self.tag("button", "B", "OK")))
        elif kind == "advert":
            inner = r.choice((self.sentence(), self.prose(), p(self.prose()), f'<a href="/ad">{self.sentence(6)}</a>', p(self.sentence()) + p(self.sentence())))
        elif kind == "form":
            inner = self.tag("label", "B", self.words(2)) + "<input name=q>" + self.tag("button", "B", self.words(1)) + (p(self.prose()) if r.random() < 0.4 else "")
        elif kind == "comments":
            one = lambda: self.tag(r.choice(("div", "li", "div", "li", "div", "article")), "B", p(self.words(2)) + self.tag("p", "B", self.prose()), r.choice(("comment", "comment", "reply", "comment-body", "")))
            inner = (self.tag("h3", "B", self.words(2)) if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5))) + (self.boilerplate("form") if r.random() < 0.3 else "")
        else:
            inner = r.choice((self.links(), self.words(5), " ".join(f'<a href="#">{self.words(1)}</a>' for _ in range(4))))
        return self.tag(tag, "B", inner, names)

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(self.tag("h1", "C", self.sentence()))
        for _ in range(r.choice((1, 2, 3, 5, 8, 14, 30, 60) if self.terse else (1, 2, 3, 5, 8, 14, 30))):
            x = r.random()
            if x < 0.72:
                inner = self.paragraph()
                out.append(self.tag("p", "C", inner) if r.random() < 0.8 else f'<p data-y="C">{"<b>" * (r.random() < 0.5)}{inner}<br>')
            elif x < 0.80:
                out.append(self.tag(r.choice(("h2", "h3", "h4")), "C", self.sentence(4)))
            elif x < 0.86:
                out.append(self.tag(r.choice(("ul", "ol")), "C", "".join(self.tag("li", "C", self.sentence()) for _ in range(r.randint(2, 6)))))
            elif x < 0.90:
                out.append(self.tag("blockquote", "C", self.tag("p", "C", self.paragraph()) if r.random() < 0.5 else self.paragraph()))
            elif x < 0.92:
                out.append(self.tag("pre", "C", self.words(12)))
            elif x < 0.95:
                row = lambda: self.tag("tr", "C", "".join(self.tag("td", "C", self.words(2)) for _ in range(3)))
                out.append(self.tag("table", "C", row() + row()))
            elif x < 0.97:
                out.append(self.tag("figure", "C", "<img src=x>" + self.tag("figcaption", "C", self.sentence(6))))
            else:
                out.append(self.tag("div", "C", self.paragraph()))
        for kind, chance in (("advert", 0.25), ("share", 0.15), ("form", 0.08), ("sidebar", 0.08), ("notice", 0.08), ("menu", 0.06)):
            if r.random() < chance:
                out.insert(r.randint(0, len(out)), self.boilerplate(kind))
        if r.random() < 0.15:
            out.append(self.boilerplate("comments"))
        body = "".join(out)
        if r.random() < 0.15:
            body = self.tag("div", "C", body, r.choice(CONTENT) if r.random() < 0.6 else "")
        x = r.random()
        if x < 0.5:
            return self.tag("article", "C", body, r.choice(CONTENT) if r.random() < 0.3 else "")
        if x < 0.65:
            return self.tag("main", "C", body)
        if x < 0.92:
            return self.tag(r.choice(("div", "div", "section")), "C", body, r.choice(CONTENT))
        return body if x < 0.96 else self.tag("div", "C", body)

    def page(self) -> str:
        r = self.r
        parts = [self.article()]
        for kind, chance, front in (("sidebar", 0.4, False), ("advert", 0.45, None), ("comments", 0.4, False), ("form", 0.25, None), ("notice", 0.35, None), ("share", 0.2, None), ("menu", 0.7, True), ("header", 0.55, True), ("footer", 0.75, False)):
            if r.random() < chance:
                ahead = r.random() < 0.5 if front is None else front
                parts.insert(0 if ahead else len(parts), self.boilerplate(kind))
        if r.random() < 0.4:
            k = r.randint(1, len(parts))
            j = r.randint(0, k - 1)
            parts[j:k] = [self.tag(r.choice(("div", "main", "section")), "O", "".join(parts[j:k]), r.choice(WRAPPERS) if r.random() < 0.7 else "")]
        body = f'<body data-y="O">{"".join(parts)}</body>'
        return body if r.random() < 0.2 else f'<!DOCTYPE html><html data-y="O"><head data-y="B"><title>x</title></head>{body}</html>'


def labelled_pages(n: int, seed: int = 0) -> list[str]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
