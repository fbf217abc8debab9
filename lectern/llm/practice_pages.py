"""Practice pages with known main text, from which the extractor learns.

Layouts, block kinds, names and texts are drawn at random from a fixed seed. Blocks are marked as
main text or not in an attribute that the features do not read.
"""

import random

#: Attribute that carries the mark.
MARK = "data-main"

#: Names that page authors give to blocks, by kind (fixed values).
NAMES = {
    "menu": "nav menu navbar navigation main-menu top-nav breadcrumb breadcrumbs pagination toc site-nav menu-list".split(),
    "header": "header site-header masthead page-header top-bar branding logo head banner-top".split(),
    "footer": "footer site-footer page-footer foot bottom copyright legal colophon".split(),
    "sidebar": "sidebar side-bar aside widget widgets related related-posts recommended recent-posts side more-stories trending".split(),
    "notice": "notice cookie-notice cookie-banner consent gdpr alert popup modal newsletter subscribe-box warning message overlay".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion ad-slot banner-ad adsbygoogle commercial".split(),
    "form": "form search search-form login signup contact-form subscribe".split(),
    "comments": "comments comment-list comment-section comment replies discussion disqus reader-comments responses feedback".split(),
    "share": "share social social-links share-buttons follow tools".split(),
    "article": "article content post entry story main article-body post-content entry-content main-content text body-text prose".split(),
    "wrap": "wrapper container page layout row inner wrap outer site col".split(),
}
_TAGS = {"menu": ["nav", "nav", "div", "ul", "section"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"], "notice": ["div", "div", "section", "p", "aside", "dialog"], "ad": ["div", "div", "aside", "section", "ins", "p"], "form": ["form"], "comments": ["div", "section", "ol", "aside"], "share": ["div", "ul", "p"]}


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        parts = [self.r.choice("bcdfghklmnprstvw") + self.r.choice("aeiouéü") + self.r.choice(["", "n", "r", "st", "l"]) for _ in range(40)]
        self.words = ["".join(self.r.choices(parts, k=self.r.choice([1, 1, 2, 2, 3]))) for _ in range(150)]
        self.named = self.r.random() < 0.75  # whether blocks are named as well as tagged

    def phrase(self, least: int, most: int, end: str = "") -> str:
        words = self.r.choices(self.words, k=self.r.randint(least, most))
        return " ".join(words).capitalize() + end

    def prose(self, sentences: int) -> str:
        out = []
        for _ in range(sentences):
            s = self.phrase(1, 22, self.r.choice(["."] * 8 + ["!", "?", ""]))
            if self.r.random() < 0.3:
                s = s.replace(" ", ", ", 1)
            if self.r.random() < 0.12:
                w = self.r.choice(self.words)
                s += self.r.choice([f' <a href="/{w}">{w}</a>', f" <b>{w}</b>", f" <em>{w}</em>", " &amp;", " 1999", f" <code>{w}</code>", " %%%", " ***"])
            out.append(s)
        return " ".join(out)

    def attrs(self, kind: str, always: bool = False) -> str:
        if not (always or self.named or self.r.random() < 0.3):
            return ""
        name = self.r.choice(NAMES[kind])
        if self.r.random() < 0.2:
            name += " " + self.r.choice(["clearfix", "js-x", "u-2", "is-open", name + "-inner"])
        out = f' {self.r.choice(["class", "class", "id"])}="{name}"'
        if self.r.random() < 0.1:
            out += f' role="{dict(menu="navigation", header="banner", footer="contentinfo", sidebar="complementary", notice="alert", form="search", article="main").get(kind, "group")}"'
        return out

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{w}">{self.phrase(1, 4)}</a></{tag}>' for w in self.r.choices(self.words, k=self.r.randint(2, 9)))

    def boiler(self, kind: str) -> str:
        tag = self.r.choice(_TAGS[kind])
        plain = tag in ("div", "section", "p", "ul", "ol", "ins", "dialog")
        a = self.attrs(kind, always=plain)
        r = self.r.random()
        if kind == "menu":
            body = self.links() if tag == "ul" else f"<ul>{self.links()}</ul>" if r < 0.7 else self.links("span")
        elif kind == "header":
            body = self.r.choice([f"<h1>{self.phrase(1, 4)}</h1>", f'<a href="/">{self.phrase(1, 3)}</a>', f"<p>{self.phrase(2, 9)}</p>", f"<div>{self.phrase(1, 5)}</div>"]) + (f"<nav><ul>{self.links()}</ul></nav>" if r < 0.4 else "")
        elif kind == "footer":
            body = self.r.choice(["&copy; ", "", "Copyright 2024 "]) + self.phrase(1, 12, self.r.choice(["", ".", " &middot; all rights reserved"])) + (f"<ul>{self.links()}</ul>" if r < 0.3 else f"<p>{self.prose(1)}</p>" if r < 0.5 else "")
        elif kind == "sidebar":
            body = f"<h3>{self.phrase(1, 3)}</h3>" + (f"<ul>{self.links()}</ul>" if r < 0.5 else f"<p>{self.prose(self.r.randint(1, 3))}</p>")
        elif kind in ("notice", "ad"):
            body = self.prose(self.r.randint(1, 2)) if tag == "p" or r < 0.55 else f"<p>{self.prose(self.r.randint(1, 3))}</p>" if r < 0.8 else f"<h4>{self.phrase(1, 4)}</h4><p>{self.prose(1)}</p><button>{self.phrase(1, 2)}</button>"
        elif kind == "form":
            body = f'<label>{self.phrase(1, 3)}</label><input name="q"><button type="submit">{self.phrase(1, 2)}</button>' if r < 0.6 else f"<p>{self.phrase(2, 8, '.')}</p><textarea></textarea><button>{self.phrase(1, 2)}</button>"
        elif kind == "comments":
            one = "li" if tag == "ol" else self.r.choice(["div", "article", "div", "p"])
            body = "" if tag == "ol" else f"<h3>{self.phrase(1, 3)}</h3>" if r < 0.6 else ""
            for _ in range(self.r.randint(1, 6)):
                inner = self.prose(self.r.randint(1, 4)) if one == "p" else f"<p>{self.prose(self.r.randint(1, 4))}</p>" if self.r.random() < 0.7 else f"<b>{self.phrase(1, 2)}</b>: {self.prose(2)}"
                body += f'<{one} class="{self.r.choice(["comment", "reply", "comment-body", "c"])}">{inner}</{one}>'
        else:
            body = self.links("li" if tag == "ul" else "span")
        return f'<{tag}{a} {MARK}="0">{body}</{tag}>'

    def content(self, blocks: int) -> list[str]:
        out = []
        loose = self.r.random() < 0.35  # paragraphs left open, line breaks
        for i in range(blocks):
            r = self.r.random()
            if i == 0 and r < 0.85:
                h = self.phrase(2, 14, self.r.choice(["", "."]))
                h1 = f'<h1 {MARK}="1">{h}</h1>'
                out.append(f'<header {MARK}="1">{h1}</header>' if self.r.random() < 0.08 else h1)
            elif r < 0.72:
                text = self.prose(self.r.choice([1, 1, 2, 3, 5, 8, 15]))
                out.append(f'<p {MARK}="1"><b>{text}<br>' if loose and self.r.random() < 0.3 else f'<p {MARK}="1">{text}' + ("" if loose and self.r.random() < 0.3 else "</p>"))
            elif r < 0.76:
                out.append(f'<p {MARK}="1">{self.phrase(1, 3, ".")}</p>')
            elif r < 0.78:
                out.append(f'<p {MARK}="1"><a href="/{self.r.choice(self.words)}">{self.phrase(1, 9, self.r.choice(["", "."]))}</a></p>')
            elif r < 0.84:
                h = self.r.choice(["h2", "h2", "h3"])
                out.append(f'<{h} {MARK}="1">{self.phrase(1, 8)}</{h}>')
            elif r < 0.9:
                t = self.r.choice(["ul", "ol"])
                out.append(f'<{t} {MARK}="1">' + "".join(f'<li {MARK}="1">{self.prose(self.r.choice([1, 1, 2]))}</li>' for _ in range(self.r.randint(2, 6))) + f"</{t}>")
            elif r < 0.93:
                out.append(f'<blockquote {MARK}="1"><p {MARK}="1">{self.prose(2)}</p></blockquote>')
            elif r < 0.96:
                out.append(f'<table {MARK}="1">' + "".join(f'<tr {MARK}="1">' + "".join(f'<td {MARK}="1">{self.phrase(1, 4)}</td>' for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 4))) + "</table>")
            elif r < 0.98:
                out.append(f'<figure {MARK}="1"><img src="x"><figcaption {MARK}="1">{self.phrase(3, 12)}</figcaption></figure>')
            else:
                out.append(f'<div {MARK}="1">{self.prose(3)}</div>')
        return out

    def page(self) -> str:
        blocks = self.content(self.r.choice([1, 2, 2, 2, 3, 3, 4, 5, 8, 13, 25]))
        inside = [k for k in ("ad", "share", "notice", "sidebar", "form") if self.r.random() < 0.15]
        for k in inside:
            blocks.insert(self.r.randint(1, len(blocks)), self.boiler(k))
        if self.r.random() < 0.12:
            blocks.append(self.boiler("comments"))
        tag = self.r.choice(["article", "article", "article", "main", "div", "section", "div"])
        text = f'<{tag}{self.attrs("article", always=tag == "div" and self.r.random() < 0.8)} {MARK}="1">{"".join(blocks)}</{tag}>'
        if self.r.random() < 0.1:  # blocks right in the body
            text = "".join(blocks)
        for _ in range(self.r.choice([0, 0, 1, 2])):
            wrap = self.r.choice(["div", "main", "section", "div"])
            text = f'<{wrap}{self.attrs(self.r.choice(["article", "wrap", "wrap"]))} {MARK}="1">{text}</{wrap}>'
        before = [self.boiler(k) for k in ("header", "menu", "notice", "ad", "form", "sidebar") if self.r.random() < (0.6 if k in ("header", "menu") else 0.3)]
        after = [self.boiler(k) for k in ("comments", "sidebar", "ad", "form", "notice", "menu", "share", "footer") if self.r.random() < (0.8 if k == "footer" else 0.28)]
        if self.r.random() < 0.3:
            self.r.shuffle(before)
            self.r.shuffle(after)
        if self.r.random() < 0.25:  # text and sidebars side by side
            side = "".join(self.boiler("sidebar") for _ in range(self.r.randint(1, 2)))
            text = f'<div{self.attrs("wrap")} {MARK}="1">' + (text + side if self.r.random() < 0.5 else side + text) + "</div>"
        return f'<!DOCTYPE html><html><head><title>{self.phrase(2, 8)}</title><style>p{{}}</style></head><body>{"".join(before)}{text}{"".join(after)}</body></html>'


def practice_pages(n: int, seed: int = 7) -> list[str]:
    return [Writer(seed * 1_000_003 + i).page() for i in range(n)]
