"""Labelled pages from which the weights of the content scorer are learned.

Pages are composed at random: a layout, parts of the page around and inside the article (menus, headers, footers, sidebars,
notices, adverts, forms, comments), each with its own tags, names and kind of content, and the article itself. Parts go without
a name, or with a name that says nothing, in a share of cases, and articles also have names in which a word usual for other
parts stands among others, so that structure, link share and length are learned beside names.
"""

from __future__ import annotations

import random

#: Parts of pages: the elements they come in, the words their names are made of, and what they hold (l: links, s: short text, p: paragraphs, f: fields).
PARTS = {
    "menu": ("nav div ul header", "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager toolbar topbar", "l"),
    "header": ("header div", "header masthead logo branding banner top", "sl"),
    "footer": ("footer div", "footer copyright legal bottom", "slp"),
    "sidebar": ("aside div td section", "sidebar side aside rail widget related recommended tags teaser", "lsp"),
    "notice": ("div section aside", "notice cookie consent gdpr alert warning notification disclaimer", "sp"),
    "advert": ("div aside section", "ad ads advert advertisement sponsor sponsored promo promotion", "sp"),
    "form": ("form form div", "form search subscribe newsletter signup login", "f"),
    "comments": ("section div ol", "comments comment discussion replies responses", "p"),
    "share": ("div ul", "share social follow", "l"),
    "popup": ("div", "modal popup overlay dialog", "sp"),
}
ARTICLE = ("article main div section td", "content article post entry story body text main page")
NEUTRAL = "wrap wrapper container row col inner box block left center".split()
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "search", "notice": "alert"}


SYLLABLES = [c + v for c in "bcdfglmnprst" for v in "aeiou"]


class _Page:
    """html with the places of the article's parts."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.spans = rng, "", []

    def word(self) -> str:
        """An invented word of one to four syllables."""
        n = int(1 + 4 * self.rng.random())
        return "".join(SYLLABLES[int(len(SYLLABLES) * self.rng.random())] for _ in range(n))

    def words(self, low: int, high: int, links: float = 0.0) -> str:
        n = self.rng.randint(low, high)
        out = [self.word() for _ in range(n)]
        if links:
            out = [f"<a href='/'>{w}</a>" if self.rng.random() < links else w for w in out]
        if n > 5 and self.rng.random() < 0.8:
            out[-1] += "."
        return " ".join(out)

    def name(self, usual: list[str], telling: bool = False) -> str:
        """A class or id, or nothing; `telling` where nothing else tells what it is."""
        r = self.rng
        kind = 1.0 if telling else r.random()
        if kind < 0.15:
            return ""
        if kind < 0.3:
            text = r.choice([self.word(), r.choice(NEUTRAL), f"{self.word()}-{r.choice(NEUTRAL)}"])
        else:
            w = r.choice(usual)
            text = r.choice([w, w, w, w, f"{r.choice(NEUTRAL)}-{w}", f"{w}-{r.choice(NEUTRAL)}", f"{self.word()}_{w}", f"{w}{r.choice(NEUTRAL).title()}", f"{w} {r.choice(usual)}"])
        return f" {r.choice(['class', 'class', 'class', 'id'])}='{text}'"

    def part(self, kind: str) -> None:
        r = self.rng
        tags, names, holds = PARTS[kind]
        tag = r.choice(tags.split())
        named = self.name(names.split(), tag in ("div", "section", "td", "ul", "ol"))
        if kind in ROLES and r.random() < 0.1:
            named += f" role='{ROLES[kind]}'"
        inner = ""
        for _ in range(r.randint(1, 3)):
            what = r.choice(holds)
            if what == "l":
                links = [f"<a href='/'>{self.words(1, 4)}</a>" for _ in range(r.randint(1, 6))]
                inner += r.choice([" ".join(links), "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"])
            elif what == "s":
                inner += r.choice(["{}", "<p>{}</p>", "<span>{}</span>", "<h3>{}</h3>", "<div>{}</div>"]).format(self.words(2, 12))
            elif what == "f":
                button = f"<button>{self.words(1, 2)}</button>"
                inner += r.choice([f"<label>{self.words(1, 3)}</label><input>{button}", f"{self.words(1, 6)} <input>", f"<p>{self.words(3, 20)}</p><input>{button}", f"<div>{self.words(1, 4)}</div><textarea></textarea>"])
            else:
                text = f"<p>{self.words(10, 60)}</p>"
                inner += f"<div class='comment'>{text}</div>" if kind == "comments" and r.random() < 0.4 else f"<article>{text}</article>" if kind == "comments" and r.random() < 0.15 else text
        wrap = f"<li>{inner}</li>" if tag in ("ul", "ol") else inner
        self.html += f"<table><tr><td{named}>{wrap}</td></tr></table>" if tag == "td" else f"<{tag}{named}>{wrap}</{tag}>"

    def article_text(self, text: str) -> None:
        start = len(self.html)
        self.html += text
        self.spans.append((start, len(self.html)))

    def block(self) -> str:
        r = self.rng
        p = lambda: self.words(4, 70, 0.03)
        return r.choice([
            lambda: f"<p>{p()}</p>", lambda: f"<p>{p()}</p>", lambda: f"<p>{p()} <b>{self.words(1, 3)}</b> {p()}</p>", lambda: f"<p>{self.words(1, 3)}</p>", lambda: f"<p>{self.words(1, 6)}</p>", lambda: f"<p>{self.words(1, 2)}<br>{p()}<br>{self.words(1, 3)}</p>", lambda: f"<div>{self.words(1, 3)}</div>", lambda: f"<h2>{self.words(1, 8)}</h2>", lambda: f"<div>{p()}</div>",
            lambda: "<ul>" + "".join(f"<li>{self.words(2, 14, 0.1)}</li>" for _ in range(r.randint(1, 5))) + "</ul>", lambda: f"<blockquote>{p()}</blockquote>", lambda: f"{p()}<br><br>{p()}", lambda: f"<pre>{p()}</pre>",
            lambda: f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr></table>", lambda: f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>", lambda: f"<section><h3>{self.words(1, 6)}</h3><p>{p()}</p></section>",
            lambda: "<div>" * (k := r.randint(1, 8)) + p() + "</div>" * k,
        ])()

    def article(self) -> None:
        r = self.rng
        tags, names = ARTICLE
        tag = r.choice(tags.split())
        usual = names.split()
        named = self.name(usual)
        if r.random() < 0.25:  # words of other parts among others
            other = r.choice(r.choice(list(PARTS.values()))[1].split())
            named = f" class='{other}-{self.word()}-{self.word()}'" if r.random() < 0.7 else f" class='{self.word()}-{other}-{self.word()}'"
        self.html += "<table><tr>" * (tag == "td") + f"<{tag}{named}>"
        if r.random() < 0.7:
            self.article_text(f"<h1>{self.words(2, 9)}</h1>")
        for _ in range(r.randint(1, 7)):
            self.article_text(self.block())
            if r.random() < 0.15:
                self.part(r.choice(["advert", "advert", "share", "form", "notice", "menu", "sidebar"]))
        self.article_text(r.choice(["", f"<p>{self.words(3, 40)}</p>"]))
        if r.random() < 0.15:
            self.part(r.choice(["comments", "share", "sidebar", "footer"]))
        self.html += f"</{tag}>" + "</tr></table>" * (tag == "td")


def page(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """(html, [(start, end) of the article's parts])."""
    p = _Page(rng)
    if rng.random() < 0.06:  # a bare text
        p.article_text(" ".join(p.block() for _ in range(rng.randint(1, 3))))
        return p.html, p.spans
    p.html = "<html><head><title>t</title></head><body>"
    depth = rng.randint(0, 2)
    for kind in rng.sample(["menu", "header", "notice", "advert", "form", "popup", "sidebar"], rng.randint(0, 4)):
        p.part(kind)
    opened = [rng.choice(["div", "main", "section"]) for _ in range(depth)]
    for tag in opened:
        p.html += f"<{tag}{p.name(NEUTRAL)}>"
    if rng.random() < 0.2:
        p.part(rng.choice(["menu", "sidebar", "notice"]))
    p.article()
    for kind in rng.sample(["comments", "sidebar", "share", "form"], rng.randint(0, 2)):
        p.part(kind)
    p.html += "".join(f"</{tag}>" for tag in reversed(opened))
    for kind in rng.sample(["comments", "footer", "advert", "sidebar", "menu"], rng.randint(0, 3)):
        p.part(kind)
    p.html += "</body></html>"
    return p.html, p.spans


def pages(n: int = 1000, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
