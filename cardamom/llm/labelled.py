"""Labelled pages made by rule: layouts, names and texts drawn at random, and which texts are the article.

No labelled pages are supplied, so the field is trained on these. The article and
what stands round it come from many shapes of markup (with and without semantic
elements, telling and meaningless names, missing end tags), so that no single sign
decides.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "an be chi da er fo gu ha in jo ka lo mi na os pe qui ra so ta un ve wo xy za th st ing tion ä é ñ ß ou eau".split()
PUNCTUATION = (".", ".", ".", "!", "?", "", "...", "%%%", " &", ";")
#: How the article is wrapped, from outside to inside; the last names the layout.
ARTICLES = (
    (("article", ""), "article"),
    (("main", ""), ("article", ""), "main"),
    (("main", ' id="content"'), "mainid"),
    (("div", ' id="content"'), ("div", ' class="post"'), "div"),
    (("div", ' class="wrapper"'), ("div", ' class="article-body"'), "body"),
    (("div", ' class="container"'), ("div", ' class="row"'), ("div", ' class="entry-content"'), "entry"),
    (("section", ' class="story"'), "section"),
    (("table", ""), ("tr", ""), ("td", ' class="text"'), "table"),
    (("div", ' class="c1"'), ("div", ' class="x7"'), "plain"),
    (("div", ""), "bare"),
    (("article", ' class="post" itemprop="articleBody"'), "item"),
)


class Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.main: list[str] = []
        self.words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3)))) for _ in range(300)]

    def some(self, low: int, high: int, end: bool = True) -> str:
        r = self.rng
        out = [r.choice(self.words[: r.choice((30, 300))]) for _ in range(r.randint(low, high))]
        out[0] = out[0].capitalize()
        for i in range(len(out)):
            if r.random() < 0.1:
                out[i] += r.choice((",", ".", ":", "&", "***", '"'))
        return " ".join(out) + (r.choice(PUNCTUATION) if end else "")

    def kept(self, text: str) -> str:
        self.main.append(" ".join(text.split()))
        return self.inline(text)

    def inline(self, text: str) -> str:
        """text with some words in links or emphasis, and escapes."""
        r, out = self.rng, []
        for w in text.split():
            w = html.escape(w, quote=r.random() < 0.5)
            x = r.random()
            out.append(f"<b>{w}</b>" if x < 0.02 else f'<a href="/{r.randrange(999)}">{w}</a>' if x < 0.05 else w)
        joined = (" " if r.random() < 0.8 else "\n ").join(out)
        return f"<b>{joined}" + ("</b>" if r.random() < 0.5 else "<br>") if r.random() < 0.1 else joined

    def p(self, inner: str, tag: str = "p") -> str:
        return f"<{tag}>{inner}" + ("" if tag in ("p", "li") and self.rng.random() < 0.2 else f"</{tag}>")

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.85:
            title = self.p(self.kept(self.some(2, 10, False)), r.choice(("h1", "h1", "h2")))
            out.append(f"<header>{title}{self.byline()}</header>" if r.random() < 0.15 else title)
        if r.random() < 0.15:
            out.append(self.byline())
        for _ in range(r.choice((1, 2, 4, 8, 15))):
            x = r.random()
            if x < 0.07:
                out.append(self.p(self.kept(self.some(1, 6, False)), r.choice(("h2", "h3"))))
            elif x < 0.12:
                out.append("<ul>" + "".join(self.p(self.kept(self.some(2, 15)), "li") for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.16:
                out.append(f"<blockquote>{self.p(self.kept(self.some(5, 40)))}</blockquote>")
            elif x < 0.18:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.kept(self.some(1, 4, False))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif x < 0.21:
                out.append(f"<figure><img src=x><figcaption>{self.kept(self.some(3, 15))}</figcaption></figure>")
            elif x < 0.26:
                out.append(self.advert())
            elif x < 0.28:
                out.append(self.notice())
            elif x < 0.45:
                out.append(self.p(self.kept(self.some(1, 4))))
            else:
                out.append(self.p(self.kept(self.some(8, r.choice((20, 80, 200))))))
        if r.random() < 0.15:
            out.append(self.share())
        return "".join(out)

    def links(self, low: int, high: int) -> str:
        r = self.rng
        return "<ul>" + "".join(f'<li><a href="/{i}">{html.escape(self.some(1, 4, False))}</a></li>' for i in range(r.randint(low, high))) + "</ul>"

    def named(self, tags: str, names: str, inner: str) -> str:
        r = self.rng
        tag, name = r.choice(tags.split()), r.choice(names.split())
        x = r.random()
        mark = f' class="{name}"' if x < 0.6 else f' id="{name}"' if x < 0.8 else "" if tag != "div" else f' class="box {name}"'
        return f"<{tag}{mark}>{inner}</{tag}>"

    def menu(self) -> str:
        return self.named("nav nav div", "menu nav navbar main-nav navigation breadcrumb site-menu", self.links(3, 9))

    def header(self) -> str:
        inner = self.p(self.inline(self.some(1, 4, False)), self.rng.choice(("h1", "p", "div"))) + (self.p(self.inline(self.some(3, 8, False))) if self.rng.random() < 0.5 else "")
        return self.named("header header div", "header masthead site-header top page-header", inner)

    def footer(self) -> str:
        r = self.rng
        text = r.choice(("&copy; ", "Copyright ", "", "&#169; 2020 ")) + html.escape(self.some(2, 15)) + r.choice((" &middot; ", " | ", " ")) + html.escape(self.some(1, 8))
        inner = r.choice((text, f"<p>{text}</p>", self.links(2, 5) + f"<div>{text}</div>"))
        return self.named("footer footer div", "footer site-footer colophon page-foot", inner)

    def advert(self) -> str:
        r = self.rng
        text = html.escape(self.some(3, 25))
        inner = r.choice((text, f"<p>{text}</p>", f'<a href="/buy">{text}</a>', f"<span>Advertisement</span><p>{text}</p>"))
        return self.named("div div aside", "ad ads advert advertisement sponsored ad-slot promo", inner)

    def notice(self) -> str:
        inner = self.p(html.escape(self.some(4, 25)))
        if self.rng.random() < 0.6:
            inner = self.p("We use cookies. " + html.escape(self.some(3, 15))) + "<button>OK</button>"
        return self.named("div div aside", "cookie-notice notice consent newsletter popup alert subscribe", inner)

    def sidebar(self) -> str:
        r = self.rng
        inner = self.p(html.escape(self.some(1, 3, False)), "h3") + r.choice((self.links(2, 6), self.p(html.escape(self.some(5, 40))), self.links(2, 4) + self.p(self.inline(self.some(10, 60)))))
        return self.named("aside aside div", "sidebar widget related side-column more-stories", inner)

    def form(self) -> str:
        inner = f"<label>{html.escape(self.some(1, 4, False))}</label><input name=q><select><option>{self.some(1, 2)}<option>{self.some(1, 2)}</select><textarea>{self.some(1, 5)}</textarea><button>{self.some(1, 2, False)}</button>"
        if self.rng.random() < 0.4:
            inner = self.p(html.escape(self.some(3, 20))) + inner
        return f'<form action="/s"{self.rng.choice(("", " class=search", " id=login"))}>{inner}</form>'

    def comments(self) -> str:
        r, out = self.rng, []
        for _ in range(r.randint(1, 6)):
            who = self.p(html.escape(self.some(1, 2, False)), r.choice(("h4", "b", "span", "div")))
            said = "".join(self.p(self.inline(self.some(3, r.choice((15, 80))))) for _ in range(r.randint(1, 2)))
            out.append(r.choice((f'<li class="comment">{who}{said}</li>', f'<div class="comment">{who}{said}</div>', f'<article class="comment">{who}{said}</article>')))
        head = self.p(r.choice(("Comments", "Reader comments", html.escape(self.some(1, 3, False)))), "h3")
        return self.named("section div ol", "comments comment-list discussion responses reader-comments", head + "".join(out) + (self.form() if r.random() < 0.3 else ""))

    def share(self) -> str:
        return self.named("div ul", "share social share-bar", "".join(f'<a href="#">{html.escape(self.some(1, 2, False))}</a> ' for _ in range(3)))

    def byline(self) -> str:
        return self.named("p div", "byline meta author", "By " + html.escape(self.some(1, 3, False)))

    def script(self) -> str:
        return self.rng.choice((f'<script>var t="</p>";f({self.rng.randrange(9)});</script>', "<style>p{margin:0}</style>", f"<!-- {self.some(1, 9)} -->", "<noscript><p>On</p></noscript>"))


def labelled_page(rng: random.Random, layouts: tuple[str, ...] | None = None) -> tuple[str, list[str]]:
    """A page and the texts of its article in order."""
    m = Maker(rng)
    before = [m.menu, m.header, m.advert, m.notice, m.form, m.script, m.sidebar]
    after = [m.footer, m.sidebar, m.comments, m.advert, m.share, m.form, m.menu, m.script]
    out = [part() for part in rng.sample(before, rng.randint(1, 5))]
    *wraps, name = rng.choice([a for a in ARTICLES if layouts is None or a[-1] in layouts])
    inner = m.article()
    if rng.random() < 0.2:
        inner += m.comments()
    opened = "".join(f"<{t}{a}>" for t, a in wraps) + inner + "".join(f"</{t}>" for t, _ in reversed(wraps))
    tail = [part() for part in rng.sample(after, rng.randint(1, 6))]
    if rng.random() < 0.5:
        tail.append(m.footer())
    title = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(m.some(2, 8))}</title><style>p{{margin:0}}</style></head><body>'
    return title + "".join(out) + opened + "".join(tail) + rng.choice(("</body></html>", "")), m.main


def labelled_pages(n: int, seed: int, layouts: tuple[str, ...] | None = None) -> list[tuple[str, list[str]]]:
    rng = random.Random(seed)
    return [labelled_page(rng, layouts) for _ in range(n)]
