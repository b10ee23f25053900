"""Labelled web pages to train the extraction on, composed by rule from a seed.

A page has a main text in one of many containers, and around and between it the
parts that pages have: menus, headers, sidebars, notices, adverts, forms, reader
comments, sharing links and footers, each under one of its usual names.  All words are
invented, so that a part can't be told by its vocabulary alone; only some parts say
the phrases that they say everywhere.
"""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Usual names of parts, as (element, attributes); and what they usually say.
MAIN = [
    ("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("main", 'id="content"'), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="post-content"'), ("div", 'class="entry-content"'),
    ("div", 'class="article-body"'), ("div", 'class="story"'), ("section", 'class="text"'), ("div", 'itemprop="articleBody"'), ("td", 'class="body"'), ("div", 'role="main"'), ("div", ""), ("div", 'class="page"'),
]
MENU = [("nav", ""), ("nav", 'class="navbar"'), ("ul", 'class="menu"'), ("div", 'id="nav"'), ("div", 'class="breadcrumbs"'), ("div", 'role="navigation"'), ("ul", 'id="main-menu"'), ("div", 'class="toc"'), ("div", 'class="pagination"')]
HEADER = [("header", ""), ("div", 'id="header"'), ("div", 'class="masthead"'), ("header", 'class="site-header"'), ("div", 'role="banner"'), ("div", 'class="topbar"')]
SIDEBAR = [("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="right"'), ("div", 'class="widget"'), ("aside", 'class="related"'), ("div", 'class="related-posts"'), ("div", 'class="side-bar"'), ("section", 'class="recommended"'), ("div", 'role="complementary"')]
NOTICE = [("div", 'class="cookie-notice"'), ("div", 'id="cookie-banner"'), ("div", 'class="notice"'), ("div", 'role="dialog"'), ("div", 'class="alert"'), ("div", 'class="consent"'), ("p", 'class="notice"'), ("div", 'class="popup modal"'), ("div", 'class="banner"'), ("div", 'role="alert"')]
ADVERT = [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'id="ad-top"'), ("div", 'class="sponsored"'), ("div", 'class="promo"'), ("ins", 'class="adsbygoogle"'), ("div", 'class="advertisement"'), ("aside", 'class="ad"'), ("p", 'class="ad"')]
FORM = [("form", ""), ("form", 'class="search"'), ("form", 'id="subscribe"'), ("div", 'class="newsletter"'), ("form", 'class="login"'), ("form", 'action="/send"')]
COMMENTS = [("section", 'id="comments"'), ("div", 'class="comments"'), ("ol", 'class="comment-list"'), ("div", 'id="disqus_thread"'), ("section", 'class="reader-comments"'), ("div", 'class="comment"'), ("div", 'class="discussion replies"'), ("ul", 'class="comments"')]
SHARE = [("div", 'class="share"'), ("ul", 'class="social"'), ("div", 'class="tags"'), ("div", 'class="author-bio share-links"')]
FOOTER = [("footer", ""), ("div", 'id="footer"'), ("div", 'class="copyright"'), ("footer", 'class="site-footer"'), ("div", 'role="contentinfo"'), ("div", 'class="footer-links"')]
SAYS = {
    "menu": ["Home", "About", "Contact", "News", "Next page", "Previous"], "notice": ["We use cookies to improve this site.", "Accept all", "Privacy policy"], "advert": ["Advertisement", "Sponsored", "Buy now"],
    "form": ["Search", "Subscribe to our newsletter", "Your email", "Log in", "Leave a reply"], "comments": ["Reply", "Comments", "Report"], "share": ["Share", "Tweet", "Print"], "footer": ["© 2024 All rights reserved", "Terms of use", "Imprint"], "sidebar": ["Related", "Most read", "Tags"], "header": ["Menu", "Sign in"],
}
ALPHABETS = ["aeiou bcdfglmnprst", "aeioué cdlmnqrstv", "aeiouäöü bdfghklnrsßt", "aeioáóñ cdglmnrsz", "аеиоу бвгдклмнпрст", "のはがをに東京本日人大"]


class _Composer:
    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        vowels, *rest = self.pick(ALPHABETS).split()
        self.sounds = [list(vowels), list(rest[0] if rest else vowels)]

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def often(self, share: float) -> bool:
        return bool(self.rng.random() < share)

    def words(self, least: int, most: int) -> list[str]:
        n = int(self.rng.integers(least, most + 1))
        return ["".join(self.pick(self.sounds[(k + i) % 2]) for k in range(int(self.rng.integers(1, 9)))) for i in range(n)]

    def prose(self, sentences: int) -> str:
        told = []
        for _ in range(sentences):
            w = self.words(1, 18)
            w = [x + "," if self.often(0.08) else x for x in w]
            told.append(" ".join(w).capitalize() + self.pick(["."] * 8 + ["?", "!", ":"]))
        text = " ".join(told)
        return text + self.pick([" & so", ' "on"', " <3", " 10 %"]) if self.often(0.05) else text

    def junk(self) -> str:
        """What stands in texts beside sentences: rows of cells, numbers, addresses, signs."""
        w = self.words(2, 25)
        kind = int(self.rng.integers(5))
        if kind == 0:
            return self.pick([" | ", " · ", " » ", "; "]).join(w)
        if kind == 1:
            return " ".join(str(int(self.rng.integers(10**6))) if self.often(0.6) else x for x in w)
        if kind == 2:
            return f"https://{w[0]}.example/{w[-1]} {w[0]}@{w[-1]}.example"
        if kind == 3:
            return " ".join(x + self.pick(["***", "%%%", "&&&", "###", "!!!"]) for x in w)
        return f"© {w[0]} {int(self.rng.integers(1990, 2030))}"

    def inside(self, text: str) -> str:
        """Text as markup, with inline elements, other white space and end tags left out."""
        words = [html.escape(w, quote=self.often(0.5)) for w in text.split(" ")]
        if len(words) > 4 and self.often(0.35):
            a, b = sorted(self.rng.integers(0, len(words), 2))
            tag = self.pick(["b", "i", "em", "strong", "span", "a", "code"])
            words[a] = (f'<a href="/{a}">' if tag == "a" else f"<{tag}>") + words[a]
            if self.often(0.85) or tag == "a":
                words[b] += f"</{tag}>"
        return self.pick([" ", " ", "\n", "\t ", " &#32;"]).join(words)

    def wrap(self, element: tuple[str, str], inner: str) -> str:
        tag, attributes = element
        return f"<{tag}{' ' + attributes if attributes else ''}>{inner}</{tag}>"

    def links(self, kind: str, least: int = 2, most: int = 8) -> str:
        told = [self.pick(SAYS[kind]) if kind in SAYS and self.often(0.4) else " ".join(self.words(1, 4)) for _ in range(int(self.rng.integers(least, most)))]
        item = self.pick(["<li>{}</li>", "<li>{}", "{} | ", "<p>{}</p>", "<div>{}</div>"])
        inner = "".join(item.format(f'<a href="/{k}">{html.escape(t)}</a>') for k, t in enumerate(told))
        return f"<ul>{inner}</ul>" if item.startswith("<li") else inner

    def part(self, kind: str, names: list[tuple[str, str]]) -> str:
        """A part that isn't main text: links, or prose that could stand anywhere."""
        element = self.pick(names)
        if kind in ("menu", "share") or kind in ("sidebar", "header", "footer") and self.often(0.4):
            return self.wrap(element, self.links(kind))
        says = [self.pick(SAYS[kind])] if self.often(0.4) else []
        if kind == "comments":
            says += [x for _ in range(int(self.rng.integers(1, 6))) for x in ([" ".join(self.words(1, 2))] if self.often(0.4) else []) + [self.prose(int(self.rng.integers(1, 6)))]]
        elif kind == "footer" and self.often(0.5):
            says = [f"© {' '.join(self.words(1, 3))} · {self.prose(int(self.rng.integers(1, 4)))}"]
        else:
            says += [self.prose(int(self.rng.integers(1, 5))) for _ in range(int(self.rng.integers(1, 3)))]
        if element[0] == "p":
            says = says[:1]
        inner = "".join(self.pick(["<p>{}</p>", "<div>{}</div>", "<p>{}"]).format(self.inside(t)) for t in says) if len(says) > 1 or self.often(0.3) and element[0] != "p" else self.inside(says[0])
        if kind == "form":
            inner += '<label>' + " ".join(self.words(1, 3)) + '</label><input name="q"><button>OK</button>'
        if element[0] in ("ol", "ul"):
            inner = f"<li>{inner}</li>"
        return self.wrap(element, inner)

    def main(self) -> tuple[str, list[str]]:
        """The main text's markup and its blocks."""
        out, told = [], []

        def add(markup: str, text: str) -> None:
            out.append(markup.format(self.inside(text)))
            told.append(text)

        if self.often(0.85):
            add("<h1>{}</h1>", " ".join(self.words(1, 10)).capitalize() + self.pick(["", "", "."]))
        for _ in range(int(self.rng.integers(1, 14)) if self.often(0.9) else 0):
            kind = self.rng.random()
            if kind < 0.08:
                add(self.pick(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<pre>{}</pre>"]), self.junk())
            elif kind < 0.68:
                text = " ".join(self.words(1, 3)).capitalize() + "." if self.often(0.15) else self.prose(int(self.rng.integers(1, 9)))
                add(self.pick(["<p>{}</p>"] * 5 + ["<p>{}", "<div>{}</div>", "<p><b>{}<br>", "<blockquote>{}</blockquote>"]), text)
            elif kind < 0.77:
                add(self.pick(["<h2>{}</h2>", "<h3>{}</h3>", "<h2 id=part>{}</h2>"]), " ".join(self.words(1, 6)).capitalize())
            elif kind < 0.83:
                item = self.pick(["<li>{}</li>", "<li>{}"])
                out.append("<ul>")
                for _ in range(int(self.rng.integers(1, 6))):
                    add(item, self.prose(1) if self.often(0.6) else " ".join(self.words(1, 5)))
                out.append("</ul>")
            elif kind < 0.86:
                out.append("<figure><img src=x>")
                add("<figcaption>{}</figcaption>", self.prose(1))
                out.append("</figure>")
            elif kind < 0.89:
                out.append("<table>")
                for _ in range(int(self.rng.integers(1, 4))):
                    out.append("<tr>")
                    for _ in range(2):
                        add("<td>{}</td>", " ".join(self.words(1, 3)))
                out.append("</table>")
            else:
                out.append(self.pick([self.part("advert", ADVERT), self.part("sidebar", SIDEBAR), self.part("share", SHARE), self.part("form", FORM), self.part("notice", NOTICE)]))
        if not told:
            add("<p>{}</p>", self.prose(2))
        return "".join(out), told

    def page(self) -> tuple[str, str]:
        inner, told = self.main()
        element = self.pick(MAIN)
        tail = self.part("comments", COMMENTS) if self.often(0.35) else ""
        if tail and self.often(0.5):
            inner, tail = inner + tail, ""
        if self.often(0.2):
            inner += self.part("share", SHARE)
        body = self.wrap(element, inner)
        if element[0] == "td":
            body = f"<table><tr>{'<td>' + self.links('menu') + '</td>' if self.often(0.5) else ''}{body}</tr></table>"
        elif self.often(0.3):
            body = self.wrap(self.pick([("div", 'class="container"'), ("div", 'id="wrapper"'), ("main", ""), ("div", 'class="row"')]), body)
        before = [self.part(k, v) for k, v, share in (("header", HEADER, 0.4), ("menu", MENU, 0.6), ("notice", NOTICE, 0.3), ("advert", ADVERT, 0.4), ("form", FORM, 0.2), ("sidebar", SIDEBAR, 0.15)) if self.often(share)]
        after = [self.part(k, v) for k, v, share in (("sidebar", SIDEBAR, 0.4), ("advert", ADVERT, 0.2), ("form", FORM, 0.25), ("notice", NOTICE, 0.15), ("menu", MENU, 0.15), ("footer", FOOTER, 0.75)) if self.often(share)]
        gap = self.pick(["", "\n", "<!-- part -->"])
        end = self.pick(["</body></html>"] * 4 + [""])
        script = '<script>var t="</p>";if(a<b)x();</script>'
        return f"<!DOCTYPE html><html><head><title>{html.escape(told[0][:60])}</title><style>p{{margin:0}}</style>{script}</head><body>{gap.join([*before, body, tail, *after])}{end}", "\n".join(told)


def composed(seed: int) -> tuple[str, str]:
    """A page and its main text."""
    return _Composer(seed).page()


def labelled_pages(spark: SparkSession, pages: int, seed: int = 12) -> DataFrame:
    """``pages`` rows of html and its main text, the same for the same seed."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([composed(int(i)) for i in pdf["id"]], columns=["html", "text"])

    return spark.range(seed * 1_000_000, seed * 1_000_000 + pages).mapInPandas(run, "html string, text string")
